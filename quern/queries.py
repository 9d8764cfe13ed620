"""The registered queries over the test tables, each with its SQL. The corpus is `documents`, whose path is
made of source, doc_id and lang; origin is the file that a row lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import ngram
from quern.functions import regex as rx
from quern.operators import index, replace, search, stats
from quern.operators.search import SearchOptions
from quern.plans import boolplan
from quern.sources.shared import shared

_PATH = "concat('/corpus/', coalesce(source, ''), '/', doc_id, '.', coalesce(lang, ''))"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where("text is not null").select(F.expr(_PATH).alias("file_path"), F.col("text").alias("content"), F.col("_metadata.file_path").alias("origin"))


_INDEXES: dict[tuple[str, str], str] = {}


def index_of(spark: SparkSession, sf_dir: str) -> str:
    """The index of a data folder, built once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES or index.current(_INDEXES[key], spark) is None:
        root = shared(spark, "index")
        index.build(corpus(spark, sf_dir), root)
        _INDEXES[key] = root
    return _INDEXES[key]


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after an edit: every tenth document gets a line, every tenth but three goes, some are new."""
    c = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    old = c.where("doc_id % 10 != 3").select(F.expr(_PATH).alias("file_path"), F.expr("case when doc_id % 10 = 0 then concat(text, '\nzebra quagga') else text end").alias("content"))
    return old.union(c.where("doc_id % 50 = 7").select(F.expr("concat('/corpus/new/', doc_id, '.txt')"), F.expr("concat('quagga ', doc_id, '\n', text)")))


_UPDATED: dict[tuple[str, str], str] = {}


def updated_index(spark: SparkSession, sf_dir: str) -> str:
    """An index of its own root, on the base of index_of, updated to edited()."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _UPDATED or index.current(_UPDATED[key], spark) is None:
        root = shared(spark, "updated")
        index.branch(spark, index_of(spark, sf_dir), root)
        index.update(edited(spark, sf_dir), root)
        _UPDATED[key] = root
    return _UPDATED[key]


def _overlay(spark: SparkSession, root: str) -> str:
    return f"{root}/{index.current(root, spark)['overlay']['folder']}"


QUERIES: dict = {}
SQL: dict[str, str] = {}
_CORPUS = f"corpus as (select {_PATH} as file_path, text as content from documents where text is not null)"
_NEW = (
    f"corpus as (select {_PATH} as file_path, case when doc_id % 10 = 0 then concat(text, chr(10), 'zebra quagga') else text end as content from documents where text is not null and doc_id % 10 <> 3 "
    "union all select concat('/corpus/new/', doc_id, '.txt'), concat('quagga ', doc_id, chr(10), text) from documents where text is not null and doc_id % 50 = 7)"
)
_LINES = "lines as (select file_path, generate_subscripts(p, 1) as line_number, unnest(p) as line_content from (select file_path, string_split(content, chr(10)) as p from corpus))"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches_sql(pattern, folded: bool = False, fixed: bool = False, where: str = "", base: str = _CORPUS) -> str:
    p = _q(rx.parse(rx.combine([pattern] if isinstance(pattern, str) else pattern, fixed), folded).re2())
    one = f"matches as (select file_path, line_number, line_content, strlen(regexp_extract(line_content, concat('(?s:\\A(.*?))(?:', {p}, ')'), 1)) as match_start, strlen(regexp_extract(line_content, {p})) as n from lines where regexp_matches(line_content, {p}){where})"
    return f"with {base}, {_LINES}, {one}"


_COLUMNS = "file_path, line_number, line_content, match_start, match_start + n as match_end"


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def _search(name: str, pattern, indexed: bool = False, where: str = "", **kw) -> None:
    o = SearchOptions(**kw)
    one = rx.combine([pattern] if isinstance(pattern, str) else pattern, o.fixed)
    folded = o.ignore_case or (o.smart_case and not any(c.isupper() for c in one))

    def run(spark, sf_dir):
        c = corpus(spark, sf_dir)
        return index.search(c, index_of(spark, sf_dir), pattern, o) if indexed else search.search(c, pattern, o)

    _add(name, run, f"{_matches_sql(pattern, folded, o.fixed, where)} select {_COLUMNS} from matches")


_search("search_literal", "the")
_search("search_regex", r"th[aeiou]+n\w* (of|and)")
_search("search_fixed", "e.", fixed=True)
_search("search_ignore_case", "THAT", ignore_case=True)
_search("search_smart_case", "thing", smart_case=True)
_search("search_smart_case_upper", "Thing", smart_case=True)
_search("search_multi", ["thing", "ungeheit", "ciónll"])
_search("search_alternation", "eau|sch|tion")
_search("search_anchored", r"^[A-Z]\w+ ")
_search("search_end_anchored", r"\.$")
_search("search_single_byte", "x")
_search("search_counted", r"[0-9]{3,}-[0-9]{2,4}")
_search("search_lazy", r"a.+?n")
_search("search_no_match", "qqqzzzqqq")
_search("filter_glob", "the", where=" and regexp_matches(file_path, '(?s)\\A.*/src1/.*\\z')", glob="*/src1/*")
_search("filter_type", "eau", where=" and regexp_extract(file_path, '[^/]\\.([^./]*)$', 1) = 'fr'", file_type="fr")
_search("indexed_search_selective", "token = ", indexed=True)
_search("indexed_search_broad", "the", indexed=True)
_search("indexed_search_alternation", "MIT License|example\\.com|GNU General", indexed=True)
_search("indexed_search_concat", r"\w+@mail\d\.example", indexed=True)
_search("indexed_search_anchored", r"^Licensed under", indexed=True)
_search("indexed_search_no_match", "AKIAqqzz", indexed=True)
_search("indexed_search_ignore_case", "License", indexed=True, ignore_case=True)
_search("indexed_search_repeat", r"(\d{4}){4}", indexed=True)

_add("scan_corpus", lambda s, d: corpus(s, d).select("file_path", F.octet_length("content").cast("long").alias("size")), f"with {_CORPUS} select file_path, strlen(content) as size from corpus")
_add("size_filter", lambda s, d: search.size_filter(corpus(s, d), 4096).select("file_path"), f"with {_CORPUS} select file_path from corpus where strlen(content) <= 4096")
_add("binary_filter", lambda s, d: search.binary_filter(corpus(s, d)).select("file_path"), f"with {_CORPUS} select file_path from corpus where position(chr(0) in left(content, 8192)) = 0")
_add("split_lines", lambda s, d: search.lines(corpus(s, d)), f"with {_CORPUS}, {_LINES} select file_path, line_number, line_content from lines")
_add(
    "search_match_all", lambda s, d: search.search(corpus(s, d), ".*"),
    f"with {_CORPUS}, {_LINES}, last as (select file_path, count(*) as n from lines group by 1) select file_path, line_number, line_content, 0 as match_start, strlen(line_content) as match_end from lines join last using (file_path) where not (line_content = '' and line_number = n)",
)
_the = _matches_sql("the")
_add("count_per_file", lambda s, d: search.count_per_file(search.search(corpus(s, d), "the")), f"{_the} select file_path, count(*) as n_lines from matches group by 1")
_add("files_with_matches", lambda s, d: search.files_with_matches(search.search(corpus(s, d), "the")), f"{_the} select distinct file_path from matches")
_add("match_exists", lambda s, d: search.search(corpus(s, d), "the").select(F.lit(True).alias("found")).limit(1), f"{_the} select true as found where exists (select 1 from matches)")
_add("total_matches", lambda s, d: search.total(search.search(corpus(s, d), "the")), f"{_the} select count(*) as n_lines from matches")
_add("max_count", lambda s, d: search.search(corpus(s, d), "the", max_count=2), f"{_the} select {_COLUMNS} from (select *, row_number() over (partition by file_path order by line_number) as k from matches) where k <= 2")
_add(
    "context_lines",
    lambda s, d: search.search(corpus(s, d), "ing", context=2).select("file_path", "line_number", F.array_join(F.transform("context_before", lambda x: x["text"]), "|").alias("before"), F.array_join(F.transform("context_after", lambda x: x["text"]), "|").alias("after")),
    f"with {_CORPUS}, p as (select file_path, string_split(content, chr(10)) as p from corpus), m as (select file_path, p, generate_subscripts(p, 1) as line_number, unnest(p) as x from p) select file_path, line_number, array_to_string(p[greatest(1, line_number - 2):line_number - 1], '|') as before, array_to_string(p[line_number + 1:line_number + 2], '|') as after from m where regexp_matches(x, 'ing')",
)
_add("format_text", lambda s, d: search.as_text(search.search(corpus(s, d), "the")), f"{_the} select file_path, line_number, concat(file_path, ':', line_number, ':', line_content) as line from matches")
_add(
    "format_json", lambda s, d: search.as_json(search.search(corpus(s, d), "the")).select(F.get_json_object("json", "$.file").alias("file"), F.get_json_object("json", "$.line").cast("long").alias("line"), F.get_json_object("json", "$.content").alias("content"), F.get_json_object("json", "$.match_end").cast("long").alias("match_end")),
    f"{_the} select file_path as file, line_number as line, line_content as content, match_start + n as match_end from matches",
)

_PAIRS = f"{_CORPUS}, hexed as (select hex(encode(content)) as h from corpus), byte as (select h, unnest(range(1, length(h) - 2, 2)) as i from hexed where length(h) >= 4), pairs as (select substr(h, i, 4) as p, count(*) as n from byte group by 1), numbered as (select ('0x' || substr(p, 1, 2))::integer as a, ('0x' || substr(p, 3, 2))::integer as b, n from pairs)"
_add("pair_frequency", lambda s, d: stats.pair_frequency(corpus(s, d)), f"with {_PAIRS} select a, b, n from numbered")
_add("top_pairs", lambda s, d: stats.top_pairs(stats.pair_frequency(corpus(s, d))), f"with {_PAIRS} select a, b, n from numbered order by n desc, a, b limit 20")
_add("corpus_weights", lambda s, d: stats.corpus_weights(stats.pair_frequency(corpus(s, d))), f"with {_PAIRS} select a, b, least(251, greatest(1, (select max(n) from numbered) // (n + 1))) as weight from numbered")
_add("listing_order", lambda s, d: search.listed(search.search(corpus(s, d), "License")).withColumn("place", F.row_number().over(Window.orderBy("file_path", "line_number"))).select("place", "file_path", "line_number"), f"{_matches_sql('License')} select row_number() over (order by file_path, line_number) as place, file_path, line_number from matches")
_add("format_counts", lambda s, d: search.as_counts(search.search(corpus(s, d), "the")), f"{_the} select file_path, concat(file_path, ':', count(*)) as line from matches group by 1")
_add("ngram_all", lambda s, d: index.extract(corpus(s, d).select(F.xxhash64("file_path").alias("file_id"), "content")).groupBy("file_id").agg(F.count("*").alias("n_grams")))


def _pair_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, n_files): how many files the index has for each pair of bytes."""
    root = index_of(spark, sf_dir)
    keys = spark.range(65536).select((F.col("id") / 256).cast("int").alias("a"), (F.col("id") % 256).cast("int").alias("b")).collect()
    pairs = [(r.a, r.b, ngram.key(bytes((r.a, r.b)))) for r in keys]
    rows = index.postings(spark, root, index.current(root, spark)["base"]).where(F.col("gram") != index.HEAD)
    pairs, rows = spark.createDataFrame(pairs, "a int, b int, gram long"), index.lists(rows, [k for *_, k in pairs])
    return rows.join(pairs, "gram").groupBy("a", "b").agg(F.sum("n").alias("n_files"))


_add("posting_sizes_of_pairs", _pair_postings, f"with {_CORPUS}, hexed as (select file_path, hex(encode(content)) as h from corpus), byte as (select file_path, h, unnest(range(1, length(h) - 2, 2)) as i from hexed where length(h) >= 4), pairs as (select distinct file_path, substr(h, i, 4) as p from byte) select ('0x' || substr(p, 1, 2))::integer as a, ('0x' || substr(p, 3, 2))::integer as b, count(*) as n_files from pairs group by p")
_add("index_stats", lambda s, d: index.status(s, index_of(s, d)).select("version", "files", "overlay_files", "overlay_grams", "tombstones", "commit"), f"with {_CORPUS} select {index.VERSION} as version, count(*) as files, 0::bigint as overlay_files, 0::bigint as overlay_grams, 0::bigint as tombstones, null::varchar as commit from corpus")
for _name, _pattern in (("and", r"token\W+= "), ("or", "MIT License|example"), ("concat", r"MIT\s+License\."), ("scan_all", r"\d")):
    # candidates that match: with the SQL's rows they show that no match is lost
    _add(
        f"candidates_{_name}", lambda s, d, p=_pattern: index.candidates(s, index_of(s, d), boolplan.build(p)).select("file_path").distinct().join(search.files_with_matches(search.search(corpus(s, d), p)), "file_path"),
        f"{_matches_sql(_pattern)} select distinct file_path from matches",
    )
_add("cover_of_literals", lambda s, d: s.createDataFrame([(t, "|".join(g.decode() for g in ngram.cover(t.encode()))) for t in ("handleExport", "hello_world", "License", "the")], "literal string, cover string"), "select * from (values ('handleExport', 'handleE|eExpo|port'), ('hello_world', 'hel|ello|o_w|_world'), ('License', 'Licens|nse'), ('the', 'the')) t(literal, cover)")

_add("search_after_update", lambda s, d: index.search(edited(s, d), updated_index(s, d), "quagga"), f"{_matches_sql('quagga', base=_NEW)} select {_COLUMNS} from matches")
_add("search_after_update_broad", lambda s, d: index.search(edited(s, d), updated_index(s, d), "thing"), f"{_matches_sql('thing', base=_NEW)} select {_COLUMNS} from matches")
_add("update_overlay", lambda s, d: index.status(s, updated_index(s, d)).select("overlay_files", "tombstones"), "select count(*) filter (where doc_id % 10 = 0) + count(*) filter (where doc_id % 50 = 7) as overlay_files, count(*) filter (where doc_id % 10 in (0, 3)) as tombstones from documents where text is not null")
_add(
    "manifest_diff", lambda s, d: index.changes(index.manifest(corpus(s, d)), index.manifest(edited(s, d))),
    f"with {_CORPUS}, new as (select * from ({'with ' + _NEW + ' select * from corpus'})) select coalesce(a.file_path, b.file_path) as file_path, case when a.file_path is null then 'added' when b.file_path is null then 'deleted' else 'changed' end as change from corpus a full join new b on a.file_path = b.file_path where a.content is distinct from b.content",
)
_add("tombstones", lambda s, d: s.read.parquet(f"{_overlay(s, updated_index(s, d))}/changes").where("change != 'added'").select("file_path"), f"select {_PATH} as file_path from documents where text is not null and doc_id % 10 in (0, 3)")

_NEWTEXT = f"with {_CORPUS}, made as (select file_path, content, regexp_replace(content, {{p}}, {{t}}, 'g') as new, len(regexp_extract_all(content, {{p}})) as n_matches from corpus where regexp_matches(content, {{p}}))"


def _replace_sql(pattern: str, to: str) -> str:
    r = rx.parse(pattern)
    return _NEWTEXT.format(p=_q(r.re2()), t=_q(rx.re2_template(rx.template(to, r))))


_add("replace_apply", lambda s, d: replace.apply(corpus(s, d), "the", "THE").select("file_path", F.md5("content").alias("digest")), f"with {_CORPUS} select file_path, md5(regexp_replace(content, 'the', 'THE', 'g')) as digest from corpus")
_add("replace_count", lambda s, d: replace.replaced(corpus(s, d), "the", "THE").select("file_path", "n_matches"), f"{_replace_sql('the', 'THE')} select file_path, n_matches from made where new <> content")
_add("replace_captures", lambda s, d: replace.replaced(corpus(s, d), r"(\w+) and (?<last>\w+)", "${last} & $1 $$").select("file_path", F.md5("content").alias("digest")), f"{_replace_sql(chr(40) + chr(92) + 'w+) and (?<last>' + chr(92) + 'w+)', '${last} & $1 $$')} select file_path, md5(new) as digest from made where new <> content")
_add(
    "replace_preview", lambda s, d: replace.preview(corpus(s, d), "thing", "THING"),
    f"{_replace_sql('thing', 'THING')}, pieces as (select file_path, string_split(content, chr(10)) as a, string_split(new, chr(10)) as b from made), numbered as (select file_path, generate_subscripts(a, 1) as line_number, unnest(a) as original, unnest(b) as replaced from pieces) select * from numbered where original <> replaced",
)
_add("replace_totals", lambda s, d: replace.totals(corpus(s, d), "thing", "THING"), f"{_replace_sql('thing', 'THING')}, changed as (select *, len(list_filter(list_zip(string_split(content, chr(10)), string_split(new, chr(10))), lambda x: x[1] <> x[2])) as n_lines from made where new <> content) select count(*) as files, coalesce(sum(n_matches), 0)::bigint as matches, coalesce(sum(n_lines), 0)::bigint as lines from changed")
for _name, _kw, _where in (("glob", {"glob": "*/src1/*"}, "regexp_matches(file_path, '(?s)\\A.*/src1/.*\\z')"), ("type", {"file_type": "en"}, "regexp_extract(file_path, '[^/]\\.([^./]*)$', 1) = 'en'"), ("size", {"max_filesize": 2000}, "strlen(content) <= 2000")):
    _add(
        f"replace_apply_{_name}", lambda s, d, kw=_kw: replace.apply(corpus(s, d), "the", "THE", SearchOptions(**kw)).select("file_path", F.md5("content").alias("digest")),
        f"with {_CORPUS} select file_path, md5(case when {_where} then regexp_replace(content, 'the', 'THE', 'g') else content end) as digest from corpus",
    )
#: As binary content, every third text with a byte before it that isn't UTF-8: what is shown and where it lies in the file.
_RAW = "case when doc_id % 3 = 0 then concat(unhex('E9'), cast(text as binary)) else cast(text as binary) end"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select(F.expr(_PATH).alias("file_path"), F.expr(_RAW).alias("content"))


_BROKEN = f"odd as (select {_PATH} as file_path, doc_id % 3 = 0 as is_odd from documents where text is not null)"
_add(
    "search_not_utf8", lambda s, d: search.search(_raw(s, d), "the"),
    f"{_the}, {_BROKEN} select file_path, line_number, case when is_odd and line_number = 1 then concat(chr(65533), line_content) else line_content end as line_content, match_start + (is_odd and line_number = 1)::int as match_start, match_start + n + (is_odd and line_number = 1)::int as match_end from matches join odd using (file_path)",
)
_add(
    "replace_not_utf8", lambda s, d: replace.replaced(_raw(s, d), "the", "THE").select("file_path", F.md5("content").alias("digest"), "n_matches"),
    f"{_replace_sql('the', 'THE')}, {_BROKEN} select file_path, md5(case when is_odd then '\\xE9'::blob || encode(new) else encode(new) end) as digest, n_matches from made join odd using (file_path) where new <> content",
)
#: A text that holds a NUL: of string content a scan and the index find it alike.
_NUL = f"corpus as (select {_PATH} as file_path, concat('zebra', chr(0), text) as content from documents where text is not null)"


def _nul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("file_path", F.concat(F.lit("zebra\0"), "content").alias("content"))


def _nul_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared(spark, "nul")
    index.build(_nul(spark, sf_dir), root)
    return index.search(_nul(spark, sf_dir), root, "License")


_add("indexed_nul_string", _nul_search, f"{_matches_sql('License', base=_NUL)} select {_COLUMNS} from matches")
_add("indexed_large_limit", lambda s, d: index.search(corpus(s, d), index_of(s, d), "example", SearchOptions(max_filesize=1 << 40)), f"{_matches_sql('example')} select {_COLUMNS} from matches")
_add("indexed_small_limit", lambda s, d: index.search(corpus(s, d), index_of(s, d), "License", SearchOptions(max_filesize=3000)), f"{_matches_sql('License', base=_CORPUS + ' ')} select {_COLUMNS} from matches join (select file_path, strlen(content) as size from corpus) using (file_path) where size <= 3000")
_add("union_of_searches", lambda s, d: search.union_distinct(*(search.search(corpus(s, d), p).select("file_path") for p in ("License", "example"))), f"{_matches_sql('License|example')} select distinct file_path from matches")
_add("intersection_of_searches", lambda s, d: search.intersect(*(search.search(corpus(s, d), p).select("file_path") for p in ("thing", "that"))), f"with {_CORPUS} select file_path from corpus where regexp_matches(content, 'thing') and regexp_matches(content, 'that')")
