"""Media columns by signature sniffing.

One Aho-Corasick automaton holds the magic bytes of all formats and the start of base64 data URIs. At
each place found a validator of the format walks its structure (chunks and checksums, segments, boxes,
pages, directories) and gives the length, or nothing. The format at the start of a payload corrects
its declared type; validated media further on are carved, outermost first. Inside of a payload that is
itself a medium nothing is carved, but for containers (PDF, ZIP) and text.

Defined results: a null or empty payload is of type "empty" with no media. A payload of no known format is
text/html, image/svg+xml, application/xml, text/plain (valid UTF-8 without control characters) or
application/octet-stream. A null declared type counts as wrong. Ties go to the longer format at the
same place. Rows are judged one by one, so repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from struct import error as StructError
from struct import unpack_from

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import pick, slices

_CONTAINERS = {"application/pdf", "application/zip", "text/html", "text/plain", "application/xml", "image/svg+xml", "application/octet-stream"}


def _png(d: bytes, o: int):
    i, first = o + 8, True
    while i + 12 <= len(d):
        n = int.from_bytes(d[i : i + 4])
        kind = d[i + 4 : i + 8]
        if i + 12 + n > len(d) or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(d[i + 4 : i + 8 + n]) != int.from_bytes(d[i + 8 + n : i + 12 + n]):
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return "image/png", i - o
    return None


def _jpeg(d: bytes, o: int):
    i, seen = o + 2, False
    while i + 4 <= len(d):
        if d[i] != 0xFF:
            return None
        m = d[i + 1]
        if m == 0xFF:
            i += 1
            continue
        if m == 0xD9:
            return ("image/jpeg", i + 2 - o) if seen else None
        n = int.from_bytes(d[i + 2 : i + 4])
        if n < 2 or m == 0:
            return None
        i += 2 + n
        if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            seen = True
        if m == 0xDA:
            while (i := d.find(b"\xff", i)) >= 0 and i + 1 < len(d) and (d[i + 1] == 0 or 0xD0 <= d[i + 1] <= 0xD7):
                i += 2
            if i < 0 or i + 1 >= len(d):
                return None
            if d[i + 1] == 0xD9:
                return ("image/jpeg", i + 2 - o) if seen else None
    return None


def _gif(d: bytes, o: int):
    i = o + 13 + (3 << ((d[o + 10] & 7) + 1) if d[o + 10] & 0x80 else 0)
    while i < len(d):
        if d[i] == 0x3B:
            return "image/gif", i + 1 - o
        if d[i] == 0x21:
            i += 2
        elif d[i] == 0x2C:
            i += 10 + (3 << ((d[i + 9] & 7) + 1) if d[i + 9] & 0x80 else 0) + 1
        else:
            return None
        while d[i]:
            i += d[i] + 1
        i += 1
    return None


_RIFF = {b"WEBP": "image/webp", b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo"}


def _riff(d: bytes, o: int):
    n = unpack_from("<I", d, o + 4)[0]
    kind = _RIFF.get(d[o + 8 : o + 12])
    if not kind or n < 4 or o + 8 + n > len(d):
        return None
    i, end = o + 12, o + 8 + n
    while i + 8 <= end:
        i += 8 + (m := unpack_from("<I", d, i + 4)[0]) + (m & 1)
    return (kind, min(len(d) - o, 8 + n + (n & 1))) if end <= i <= end + 1 else None


def _pdf(d: bytes, o: int):
    stop = d.find(b"%PDF-", o + 5)
    i = d.rfind(b"%%EOF", o, stop if stop > 0 else len(d))
    if i < 0 or d.rfind(b"startxref", o, i) < 0:
        return None
    i += 5
    while i < len(d) and d[i] in b"\r\n" and i < o + len(d):
        i += 1
    return "application/pdf", i - o


_LAST: list = [None, {}, set()]


def _archives(d: bytes) -> tuple[dict[int, int], set[int]]:
    """({where an archive begins: where it ends}, where entries begin that a directory names), in one pass over a payload;
    kept for as long as it is the same one."""
    if _LAST[0] is d:
        return _LAST[1], _LAST[2]
    whole, entries, i = {}, set(), 0
    while (i := d.find(b"PK\x05\x06", i)) >= 0:
        if i + 22 <= len(d):
            size, at, note = unpack_from("<IIH", d, i + 12)
            top = i
            if d[i - 20 : i - 16] == b"PK\x06\x07" and i >= 76 and d[i - 76 : i - 72] == b"PK\x06\x06":  # the long form
                top = i - 76
                size, at = unpack_from("<QQ", d, top + 40)
            o = top - at - size
            if o >= 0 and d[o + at : o + at + 4] == b"PK\x01\x02" and i + 22 + note <= len(d):
                whole.setdefault(o, i + 22 + note)
                j = o + at
                while j + 46 <= top and d[j : j + 4] == b"PK\x01\x02":
                    a, b, c = unpack_from("<HHH", d, j + 28)
                    if (first := o + unpack_from("<I", d, j + 42)[0]) > o:
                        entries.add(first)
                    j += 46 + a + b + c
        i += 4
    _LAST[:] = d, whole, entries
    return whole, entries


def _zip(d: bytes, o: int):
    whole, entries = _archives(d)
    return ("application/zip", whole[o] - o) if o in whole and o not in entries else None


def _gzip(d: bytes, o: int):
    z = zlib.decompressobj(31)
    i = o
    while i < len(d) and not z.eof:
        part, i = d[i : i + 65536], i + 65536
        while part and not z.eof:
            z.decompress(part, 1 << 20)
            part = z.unconsumed_tail
    return ("application/gzip", min(i, len(d)) - len(z.unused_data) - o) if z.eof else None


_RATES = ((0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))


def _mp3_frames(d: bytes, i: int) -> int:
    """Where the run of layer III frames that begins at i ends."""
    while i + 4 <= len(d) and d[i] == 0xFF and d[i + 1] & 0xE6 == 0xE2:
        version, rate, hz = d[i + 1] >> 3 & 3, d[i + 2] >> 4, d[i + 2] >> 2 & 3
        if version == 1 or rate in (0, 15) or hz == 3:
            break
        n = (144000 if version == 3 else 72000) * _RATES[version != 3][rate] // ((44100, 48000, 32000)[hz] >> {3: 0, 2: 1, 0: 2}[version]) + (d[i + 2] >> 1 & 1)
        if i + n > len(d):
            break
        i += n
    return i


def _id3(d: bytes, o: int):
    if d[o + 3] > 4 or any(x & 0x80 for x in d[o + 6 : o + 10]):
        return None
    begin = o + 10 + (d[o + 6] << 21 | d[o + 7] << 14 | d[o + 8] << 7 | d[o + 9])
    end = _mp3_frames(d, begin)
    return ("audio/mpeg", end - o) if end > begin else None


def _ogg(d: bytes, o: int):
    i = o
    while d[i : i + 4] == b"OggS" and i + 27 <= len(d) and d[i + 4] == 0:
        n = d[i + 26]
        last, i = d[i + 5] & 4, i + 27 + n + sum(d[i + 27 : i + 27 + n])
        if i > len(d):
            return None
        if last and d[i : i + 4] != b"OggS":
            return "audio/ogg", i - o
    return None


def _flac(d: bytes, o: int):
    i, first = o + 4, True
    while i + 4 <= len(d):
        kind, n = d[i], int.from_bytes(d[i + 1 : i + 4])
        if first and (kind & 127 or n != 34):
            return None
        i, first = i + 4 + n, False
        if kind & 128:
            return ("audio/flac", len(d) - o) if i + 2 <= len(d) and d[i] == 0xFF and d[i + 1] & 0xFC == 0xF8 else None
    return None


def _mp4(d: bytes, o: int):
    i, kinds = o, []
    while i + 8 <= len(d):
        n, kind = int.from_bytes(d[i : i + 4]), d[i + 4 : i + 8]
        if n == 1 and i + 16 <= len(d):
            n = int.from_bytes(d[i + 8 : i + 16])
        if n < 8 or i + n > len(d) or not re.fullmatch(rb"[a-zA-Z0-9 ]{4}", kind):
            break
        kinds.append(kind)
        i += n
    if not {b"moov", b"mdat", b"meta", b"moof"} & set(kinds):
        return None
    brand = d[o + 8 : o + 12]
    return {b"avif": "image/avif", b"heic": "image/heic", b"M4A ": "audio/mp4", b"qt  ": "video/quicktime"}.get(brand, "video/mp4"), i - o


def _bmp(d: bytes, o: int):
    n, none, at, dib = unpack_from("<IIII", d, o + 2)
    return ("image/bmp", n) if not none and dib in (12, 40, 52, 56, 64, 108, 124) and 14 + dib <= at < n <= len(d) - o else None


_WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def _tiff(d: bytes, o: int):
    e = "<" if d[o] == 0x49 else ">"
    at, end, seen = unpack_from(e + "I", d, o + 4)[0], 8, set()
    while at and at not in seen:
        seen.add(at)
        n = unpack_from(e + "H", d, o + at)[0]
        tags: dict[int, list[int]] = {}
        for k in range(n):
            p = o + at + 2 + 12 * k
            tag, kind, count = unpack_from(e + "HHI", d, p)
            if kind not in _WIDTHS:
                return None
            size = _WIDTHS[kind] * count
            place = p + 8 if size <= 4 else o + unpack_from(e + "I", d, p + 8)[0]
            if place + size > len(d):
                return None
            end = max(end, place + size - o) if size > 4 else end
            if tag in (273, 279, 324, 325):
                tags[tag] = list(unpack_from(f"{e}{count}{'H' if kind == 3 else 'I'}", d, place))
        for a, b in ((273, 279), (324, 325)):
            end = max([end, *(x + y for x, y in zip(tags.get(a, []), tags.get(b, [])))])
        end = max(end, at + 6 + 12 * n)
        at = unpack_from(e + "I", d, o + at + 2 + 12 * n)[0]
    return ("image/tiff", end) if seen and o + end <= len(d) else None


def _vint(d: bytes, i: int) -> tuple[int, int]:
    n = 9 - d[i].bit_length()
    return int.from_bytes(d[i : i + n]) & ((1 << 7 * n) - 1), i + n


def _ebml(d: bytes, o: int):
    n, i = _vint(d, o + 4)
    head, i = d[i : i + n], i + n
    if d[i : i + 4] != b"\x18\x53\x80\x67":
        return None
    m, j = _vint(d, i + 4)
    known = m != (1 << 7 * (j - i - 4)) - 1
    if known and j + m > len(d):
        return None
    return "video/webm" if b"webm" in head else "video/x-matroska", (j + m if known else len(d)) - o


#: (magic, where the file begins before it, validator, only at the start of a payload)
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", 0, _png, False), (b"\xff\xd8\xff", 0, _jpeg, False), (b"GIF87a", 0, _gif, False), (b"GIF89a", 0, _gif, False),
    (b"RIFF", 0, _riff, False), (b"%PDF-", 0, _pdf, False), (b"PK\x03\x04", 0, _zip, False), (b"\x1f\x8b\x08", 0, _gzip, False), (b"ID3", 0, _id3, False),
    (b"OggS", 0, _ogg, False), (b"fLaC", 0, _flac, False), (b"ftyp", 4, _mp4, False), (b"BM", 0, _bmp, True), (b"II*\0", 0, _tiff, False), (b"MM\0*", 0, _tiff, False),
    (b"\x1a\x45\xdf\xa3", 0, _ebml, False),
)
_URI = re.compile(rb"data:([\w.+-]+/[\w.+-]+)?(?:;[\w=.-]+)*;base64,([A-Za-z0-9+/\s]+={0,2})")
_TEXTS = ((re.compile(rb"\s*+(?:<!--(?>.*?-->)\s*+)*+<(?:!doctype\s++html|html|head|body)\b", re.I | re.S), "text/html"), (re.compile(rb"\s*+(?:<\?xml[^>]*+>\s*+)?+(?:<!--(?>.*?-->)\s*+)*+(?:<!doctype[^>]*+>\s*+)?+(?:<!--(?>.*?-->)\s*+)*+<svg\b", re.I | re.S), "image/svg+xml"), (re.compile(rb"\s*+<\?xml\b", re.I), "application/xml"))
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1a\x1c-\x1f]")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, (magic, *_) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), (k, len(magic)))
    a.add_word("data:", (-1, 5))
    a.make_automaton()
    return a


def _valid(k: int, data: bytes, at: int):
    try:
        return FORMATS[k][2](data, at)
    except (IndexError, StructError, zlib.error):
        return None


def sniff(data: bytes, a: ahocorasick.Automaton) -> tuple[str, bool, list[tuple[int, int, str, str, int]]]:
    """(type, whether its structure is whole, carved media as (offset, length, type, encoding, digest))."""
    if not data:
        return "empty", False, []
    found: list[tuple[int, int, str, str, int]] = []
    solid = 0  # so far reach media that nothing is carved out of
    for end, (k, n) in a.iter(data.decode("latin-1")):
        at = end - n + 1
        if k < 0:
            m = _URI.match(data, at)
            if m:
                raw = b"".join(m[2].split())
                try:
                    inner = base64.b64decode(raw + b"=" * (-len(raw) % 4))
                except binascii.Error:
                    continue
                kind, whole, _ = sniff(inner, a)
                if whole:
                    found.append((at, m.end() - at, kind, "base64", xxhash.xxh3_64_intdigest(inner) >> 1))
            continue
        at -= FORMATS[k][1]
        if at < 0 or (FORMATS[k][3] and at) or at < solid:
            continue
        if got := _valid(k, data, at):
            found.append((at, got[1], got[0], "raw", xxhash.xxh3_64_intdigest(data[at : at + got[1]]) >> 1))
            if got[0] not in _CONTAINERS:
                solid = max(solid, at + got[1])
    found.sort(key=lambda x: (x[0], -x[1]))
    root = next((x for x in found if x[0] == 0 and x[3] == "raw"), None)
    if root:
        kind = root[2]
    else:
        kind = next((t for p, t in _TEXTS if p.match(data)), None)
        if kind is None:
            try:
                data.decode()
                kind = "application/octet-stream" if _CONTROL.search(data) else "text/plain"
            except UnicodeDecodeError:
                kind = "application/octet-stream"
    carved, free = [], (root[1] if root and kind not in _CONTAINERS else 0)
    for x in found:
        if x is not root and x[0] >= free:
            carved.append(x)
            free = x[0] + x[1]
    return kind, root is not None or kind.startswith("text/") or kind.endswith("xml"), carved


_MEDIA = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("encoding", pa.string()), ("digest", pa.int64())]))
SCHEMA = "id long, declared string, type string, whole boolean, corrected boolean, media array<struct<offset:long,length:long,type:string,encoding:string,digest:long>>"


def inspect(rows: DataFrame, key: str, payload: str, declared: str) -> DataFrame:
    """(id, declared, type, whole, corrected, media) of each payload (binary or string)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        a = automaton()
        for b in slices(batches, "p", 4 << 20):
            said = b.column(2).to_pylist()
            got = [sniff(p or b"", a) for p in b.column(1).to_pylist()]
            cols = [b.column(0), b.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_())]
            cols.append(pa.array([(s or "").split(";")[0].strip().lower() != g[0] for s, g in zip(said, got)], pa.bool_()))
            cols.append(pa.array([[dict(zip(("offset", "length", "type", "encoding", "digest"), m)) for m in g[2]] for g in got], _MEDIA))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    base = pick(rows, k=key, p=payload, d=declared).select(F.col("k").try_cast("long").alias("k"), F.col("p").cast("binary"), F.col("d").cast("string"))
    return base.mapInArrow(run, SCHEMA)


_BY_END = {"html": "text/html", "htm": "text/html", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "mp3": "audio/mpeg", "mp4": "video/mp4", "wav": "audio/wav", "ogg": "audio/ogg", "txt": "text/plain", "xml": "application/xml"}


def declared_by_url(url: str):
    """The type that the end of a URL's path declares; text/html where it has none."""
    end = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z]+://[^/?#]*)?[^?#]*\.([A-Za-z0-9]{2,5})(?:[?#]|$)", 1))
    out = F.lit("text/html")
    for k, v in _BY_END.items():
        out = F.when(end == k, F.lit(v)).otherwise(out)
    return out
