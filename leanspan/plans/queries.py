"""Registered queries of the engine's own operators, and the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leanspan.functions import text as T
from leanspan.functions.tokens import estimate
from leanspan.operators import aggregates as A
from leanspan.operators import derive as D
from leanspan.operators import diff as X
from leanspan.operators import evidence as G
from leanspan.operators import joins as J
from leanspan.operators import jsonops as S
from leanspan.operators import ranking as K
from leanspan.operators import receipts as P
from leanspan.operators import retrieval as R
from leanspan.operators import search as H
from leanspan.operators import serving as V
from leanspan.operators import symbols as Y
from leanspan.sources import index as N
from leanspan.sources.discovery import page_after, read_lines
from leanspan.sources.tables import table
from leanspan.streaming import changes as C

from .context import Demand, candidates, context, seed_paths, task_queries

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, tuple[Query, str | None]] = {}

TASKS = [
    (1, "Fix the cursor overflow in resolve_path while keeping the journal format unchanged"),
    (2, "Find where the ledger snapshot is compared and add a regression test for the token budget"),
    (3, "Why does the parser fail with a timeout in `scan_registry` instead of returning the stale catalog?"),
]
DEMANDS = {2: Demand(paths=("atlas-monorepo/docs",), evidence=("falls back to a full scan",), focus=("atlas-monorepo/**",)), 3: Demand(symbols=("run",))}
SEARCHES = [("overflow", ["cursor", "ledger", "overflow"]), ("header", ["reads", "header", "digest"]), ("lock", ["callers", "must", "hold", "lock"])]
PATTERN = r"(compute|count)s? how many [a-z]+ entries"
EXCLUDED = ["**/vendor/**", "**/third_party/**"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _registry[f.__name__] = (f, sql)
        return f

    return add


def _distinct(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table with duplicate deliveries of an id removed."""
    return table(spark, d, name).dropDuplicates(["id"])


_WS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LANGUAGE = "case lower(regexp_extract({0}, '[^/]\\.([^./]*)$', 1)) " + " ".join(f"when '{e}' then '{n}'" for e, n in T.EXTENSION_LANGUAGES.items()) + " end"


def _language(c: str) -> str:
    return _LANGUAGE.replace("{0}", c)


def _tokens(c: str) -> str:
    return f"(case when length({c}) = 0 then 0 else greatest(cast(ceil(length({c}) / 4.0) as bigint), len(regexp_extract_all({c}, '[^{_WS}]+')), 1) end)"


def _path_class(c: str) -> str:
    low = f"lower({c})"
    prog = ", ".join(f"'{x}'" for x in T.PROGRAMMING)
    return (
        f"case when regexp_matches({low}, '{T.AUXILIARY_PATH}') or (not contains({low}, '/') and regexp_matches({low}, '\\.mdx?$') and {low} not in ('readme.md', 'contributing.md')) then 'auxiliary' "
        f"when (({_language(c)}) in ('java', 'csharp') and (regexp_matches({c}, '{T.CLASS_TEST_PATH}') or regexp_matches({low}, '\\.tests(/|$)'))) or regexp_matches({low}, '{T.TEST_PATH}') then 'test' "
        f"when regexp_matches({low}, '{T.SUPPORTING_PATH}') then 'supporting' when ({_language(c)}) in ({prog}) then 'production' else 'supporting' end"
    )


_CHUNKS = "(select distinct on (id) * from chunks)"
_SYMBOLS = "(select distinct on (id) * from symbols)"
_TERMS = "list_filter(string_split_regex(lower({0}), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


def _terms(c: str) -> str:
    return _TERMS.replace("{0}", c)


# --- scans, sources, derivation ----------------------------------------------
@query("select count(distinct id) as files, cast(sum(size_bytes) as bigint) as bytes, (select count(distinct id) from chunks) as chunks, (select count(distinct id) from symbols) as symbols from files")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.corpus_counts(table(spark, d, "files"), table(spark, d, "chunks"), table(spark, d, "symbols"))


@query(
    f"""with f as (select coalesce({_language('path')}, '.' || nullif(lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)), ''), '[none]') as family, structurally_complete as complete, size_bytes from files),
t as (select family, row_number() over (order by count(*) desc, family) as place from f group by family)
select case when place <= 20 then f.family else 'other' end as family, complete, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from f join t on t.family = f.family group by 1, 2"""
)
def coverage_by_language(spark: SparkSession, d: str) -> DataFrame:
    return A.parser_coverage(table(spark, d, "files"))


# the last line is recomputed: a few recorded ones count the empty line after a final line end
@query("select distinct file_id, start_line, start_line + greatest(len(content) - len(replace(content, chr(10), '')) - cast(content like '%' || chr(10) as int), 0) as end_line, start_byte, end_byte, md5(content) as digest from chunks")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    c = D.chunk_files(table(spark, d, "files"))
    return c.select("file_id", "start_line", "end_line", "start_byte", "end_byte", F.md5("content").alias("digest"))


@query("select id, case when content = '' then 0 else len(content) - len(replace(content, chr(10), '')) + (case when content like '%' || chr(10) then 0 else 1 end) end as lines, coalesce(list_sum(list_transform(range(1, len(string_split(content, chr(10)))), lambda i: strlen(array_to_string(string_split(content, chr(10))[1:i], chr(10))) + 1)) - (case when content like '%' || chr(10) then strlen(content) else 0 end), 0)::bigint as offsets from files")
def line_index(spark: SparkSession, d: str) -> DataFrame:
    starts = T.line_starts("content")
    return table(spark, d, "files").select("id", T.line_count("content").alias("lines"), F.aggregate(starts, F.lit(0).cast("long"), lambda a, x: a + x).alias("offsets"))


@query("select id, substr(sha256(content), 1, 32) as fingerprint, substr(sha256(content), 1, 32) = content_hash as unchanged from files")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("id", T.fingerprint("content").alias("fingerprint"), "content_hash")
    return f.select("id", "fingerprint", (F.col("fingerprint") == F.col("content_hash")).alias("unchanged"))


@query(f"select id, {_tokens('content')} as tokens, token_count is distinct from {_tokens('content')} as stale from {_CHUNKS}")
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = _distinct(spark, d, "chunks").select("id", "token_count", estimate("content").alias("tokens"))
    return c.select("id", "tokens", (~F.col("token_count").eqNullSafe(F.col("tokens"))).alias("stale"))


@query(f"select id, {_language('path')} as by_path, language is not distinct from {_language('path')} as agrees from files")
def identifier_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", T.language_of("path").alias("by_path"), F.col("language").eqNullSafe(T.language_of("path")).alias("agrees"))


@query("select id, case when contains(content, chr(0)) or len(regexp_extract_all(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')) * 10 > strlen(content) * 3 then 'binary' else 'text' end as kind from files")
def text_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", T.text_kind("content").alias("kind"))


@query("select id, list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'), '([0-9])([A-Za-z])', '\\1_\\2', 'g'), '_+'), lambda x: x <> '') as words from " + _SYMBOLS)
def identifier_split(spark: SparkSession, d: str) -> DataFrame:
    return _distinct(spark, d, "symbols").select("id", T.identifier_words("name").alias("words"))


@query(f"select id, {_path_class('path')} as class, case {_path_class('path')} when 'production' then 4.0::double when 'auxiliary' then -8.0::double else 0.0::double end as prior from files")
def path_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", T.path_class("path").alias("class"), T.path_prior("path").alias("prior"))


@query("with p as (select distinct path, string_split(path, '/') as parts from files), e as (select array_to_string(parts[1:i], '/') as path, cast(i as int) as depth, 0 as kind from (select parts, unnest(range(1, len(parts))) as i from p) union select path, len(parts), 1 from p) select * from e")
def path_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return D.path_entries(table(spark, d, "files"))


@query(None)
def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    return D.headings(table(spark, d, "files"))


@query(None)
def imports_resolved(spark: SparkSession, d: str) -> DataFrame:
    return D.resolve_imports(table(spark, d, "files"))


@query(None)
def reverse_imports(spark: SparkSession, d: str) -> DataFrame:
    """Importers of every path that some import may mean, resolved or not: who has to be looked at again when it changes."""
    r = D.resolve_imports(table(spark, d, "files"))
    return r.select(F.explode("candidates").alias("changed"), F.col("path").alias("importer")).distinct().groupBy("changed").agg(F.count("*").alias("importers"))


@query(None)
def import_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """For each file its first three resolved imports by line and, of each target, the first two symbols."""
    r = D.resolve_imports(table(spark, d, "files")).filter("resolved_path is not null")
    firsts = D.top_n(r, ["file_id"], [F.asc("line"), F.asc("raw_target")], 3).select("path", "resolved_path", "line")
    ids = table(spark, d, "files").select(F.col("path").alias("resolved_path"), F.col("id").alias("target_id"))
    syms = D.top_n(_distinct(spark, d, "symbols"), ["file_id"], [F.asc("start_byte"), F.asc("id")], 2).select(F.col("file_id").alias("target_id"), "name", "kind")
    return firsts.join(ids, "resolved_path").join(syms, "target_id").select("path", "line", "resolved_path", "name", "kind")


@query(
    f"""with s as {_SYMBOLS}, p as (select a.id, b.id as container_id, b.name as container, row_number() over (partition by a.id order by b.end_byte - b.start_byte, -b.start_byte, b.id) as n from s a join s b
on a.file_id = b.file_id and b.start_byte <= a.start_byte and a.end_byte <= b.end_byte and b.end_byte - b.start_byte > a.end_byte - a.start_byte) select s.id, p.container_id, p.container from s left join p on p.id = s.id and p.n = 1"""
)
def symbol_parents(spark: SparkSession, d: str) -> DataFrame:
    return D.parents_by_containment(table(spark, d, "symbols"))


@query(
    """with c as (select distinct file_id, start_line, end_line, start_byte, end_byte, start_line + greatest(len(content) - len(replace(content, chr(10), '')) - cast(content like '%' || chr(10) as int), 0) as e from chunks)
select file_id, start_line, e as end_line, start_byte, end_byte, 'left' as side from c where e <> end_line union all select file_id, start_line, end_line, start_byte, end_byte, 'right' from c where e <> end_line"""
)
def projection_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the files give and the table lacks, or the other way round; none when the index is sound."""
    cols = ["file_id", "start_line", "end_line", "start_byte", "end_byte"]
    return D.symmetric_difference(D.chunk_files(table(spark, d, "files")).select(*cols), table(spark, d, "chunks").select(*cols).distinct())


# --- filters and listings ----------------------------------------------------
@query("select id, path from files where regexp_matches(path, '/(src|lib)/') and not regexp_matches(path, '/(vendor|third_party)/')")
def path_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").filter(T.path_filter("path", ["**/{src,lib}/**"], EXCLUDED)).select("id", "path")


@query("select path, language from files where regexp_matches(path, '/test_[^/]*\\.(py|rs)$')")
def glob_listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").filter(T.path_filter("path", ["**/test_*.{py,rs}"])).select("path", "language")


@query("with e as (select distinct array_to_string(string_split(path, '/')[1:i], '/') as path, cast(i as int) as depth, cast(i = len(string_split(path, '/')) as int) as kind from (select path, unnest(range(1, len(string_split(path, '/')) + 1)) as i from files)) select path, depth, kind from e where path like 'atlas-monorepo/%' and depth <= 3")
def tree_listing(spark: SparkSession, d: str) -> DataFrame:
    return D.path_entries(table(spark, d, "files")).filter(T.path_matches("path", "atlas-monorepo") & (F.col("path") != "atlas-monorepo") & (F.col("depth") <= 3)).select("path", "depth", "kind")


@query("select id, path from files where id > 100 order by id limit 50")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return page_after(table(spark, d, "files").select("id", "path"), "id", 100, 50)


@query("select path, least(3, n) as first, least(6, n) as last, array_to_string(string_split(content, chr(10))[least(3, n):least(6, n)], chr(10)) as content from (select *, len(string_split(content, chr(10))) - cast(content like '%' || chr(10) as int) as n from files) where path = (select min(path) from files where language = 'python' and size_bytes > 500)")
def read_range(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files")
    path = f.filter("language = 'python' and size_bytes > 500").agg(F.min("path")).first()[0]
    return read_lines(f, path or "", 3, 6).select("path", F.col("first").cast("long"), F.col("last").cast("long"), "content")


# --- joins -------------------------------------------------------------------
@query(f"select c.id as chunk_id, count(*) as symbols, cast(sum(least(c.end_line, s.end_line) - greatest(c.start_line, s.start_line) + 1) as bigint) as shared_lines from {_CHUNKS} c join {_SYMBOLS} s on s.file_id = c.file_id and s.start_line <= c.end_line and c.start_line <= s.end_line group by 1")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = _distinct(spark, d, "chunks").select("file_id", F.col("id").alias("chunk_id"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    s = _distinct(spark, d, "symbols").select("file_id", F.col("id").alias("symbol_id"), F.col("start_line").alias("c"), F.col("end_line").alias("d"))
    return J.overlap_join(c, s, "file_id").groupBy("chunk_id").agg(F.count("*").alias("symbols"), F.sum(F.least("b", "d") - F.greatest("a", "c") + 1).alias("shared_lines"))


@query(
    f"""with h as (select c.id as chunk_id, s.id as symbol_id, s.name, row_number() over (partition by c.id order by s.end_line - s.start_line, s.start_byte, s.id) as n from {_CHUNKS} c join {_SYMBOLS} s on s.file_id = c.file_id and s.start_line <= c.end_line and c.end_line <= s.end_line)
select c.id as chunk_id, h.symbol_id, h.name from {_CHUNKS} c left join h on h.chunk_id = c.id and h.n = 1"""
)
def enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    c = _distinct(spark, d, "chunks").select("file_id", F.col("id").alias("point_id"), F.col("end_line").alias("at"))
    s = _distinct(spark, d, "symbols").select("file_id", F.col("start_line").alias("c"), F.col("end_line").alias("d"), F.struct("start_byte", "id").alias("tie"), F.col("id").alias("symbol_id"), "name")
    return J.narrowest_enclosing(c, s, "file_id").select(F.col("point_id").alias("chunk_id"), "symbol_id", "name")


@query(f"select f.id, max(c.end_line) as end_line, count(c.id) as chunks from files f left join {_CHUNKS} c on c.file_id = f.id group by 1")
def file_end_lines(spark: SparkSession, d: str) -> DataFrame:
    c = _distinct(spark, d, "chunks").groupBy(F.col("file_id").alias("id")).agg(F.max("end_line").alias("end_line"), F.count("*").alias("chunks"))
    return table(spark, d, "files").select("id").join(c, "id", "left").select("id", "end_line", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("with p as (select path, any_value(content_hash) as h, any_value(size_bytes) as z, any_value(coalesce(language, '')) as l, max(generation) as g from files group by path), m as (select max(generation) as m from files), a as (select h, z, l, min(path) as before from p, m where g < m group by 1, 2, 3 having count(*) = 1), b as (select h, z, l, min(path) as after from p, m where g = m group by 1, 2, 3 having count(*) = 1) select a.h as content_hash, a.z as size_bytes, a.l as lang, before, after from a join b using (h, z, l)")
def relocations(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("path", "content_hash", "size_bytes", F.coalesce("language", F.lit("")).alias("lang"), "generation")
    now = f.agg(F.max("generation").alias("now"))
    f = f.crossJoin(F.broadcast(now))  # one row
    keys = ["content_hash", "size_bytes", "lang"]
    return X.relocations(f.filter("generation < now"), f.filter("generation = now"), keys)


@query("with c as (select distinct path, lower(trim(kind)) as kind, ts from changes where path is not null), l as (select path, arg_max(kind, (ts, kind)) as kind from c group by path) select path, case when f.path is null and kind = 'deleted' then 'deleted' when f.path is null then 'missing' when l.path is null then 'unlogged' when kind = 'deleted' then 'stale' else 'indexed' end as status from l full join (select distinct path from files) f using (path)")
def change_set(spark: SparkSession, d: str) -> DataFrame:
    last = X.latest_changes(table(spark, d, "changes")).select("path", "kind")
    f = table(spark, d, "files").select("path", F.lit(True).alias("there")).distinct()
    gone = F.col("kind") == "deleted"
    status = F.when(F.col("there").isNull() & gone, "deleted").when(F.col("there").isNull(), "missing").when(F.col("kind").isNull(), "unlogged").when(gone, "stale").otherwise("indexed")
    return last.join(f, "path", "full").select("path", status.alias("status"))


@query("with c as (select distinct path, lower(trim(kind)) as kind, ts from changes where path is not null) select path, arg_max(kind, (ts, kind)) as kind, max(ts) as ts from c group by path")
def latest_base(spark: SparkSession, d: str) -> DataFrame:
    return X.latest_changes(table(spark, d, "changes"))


@query(
    f"""with s as (select s.*, f.repository, f.generation from {_SYMBOLS} s join files f on f.id = s.file_id), m as (select max(generation) as m from files),
a as (select repository, name, kind, parent, count(*) as n, min(signature) as sig from s, m where generation < m group by all), b as (select repository, name, kind, parent, count(*) as n, min(signature) as sig from s, m where generation = m group by all)
select repository, name, kind, parent, case when coalesce(a.n, 0) > 1 or coalesce(b.n, 0) > 1 then 'ambiguous' when a.n is null then 'added' when b.n is null then 'removed' when regexp_replace(coalesce(a.sig, ''), '\\s+', ' ', 'g') <> regexp_replace(coalesce(b.sig, ''), '\\s+', ' ', 'g') then 'modified_signature' else 'unchanged' end as change
from (select repository, name, kind, coalesce(parent, '') as parent, n, sig from a) a full join (select repository, name, kind, coalesce(parent, '') as parent, n, sig from b) b using (repository, name, kind, parent)"""
)
def symbol_changes(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "repository", "generation")
    now = f.agg(F.max("generation").alias("now"))
    s = _distinct(spark, d, "symbols").join(f, "file_id").crossJoin(F.broadcast(now)).select("repository", "name", "kind", F.coalesce("parent", F.lit("")).alias("parent"), "signature", F.lit(None).cast("string").alias("body"), (F.col("generation") == F.col("now")).alias("current"))
    keys = ["repository", "name", "kind", "parent"]
    return X.symbol_changes(s.filter("not current"), s.filter("current"), keys).select(*keys, "change")


def _changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbol changes with the fingerprint of each symbol's code after its signature, cut from its file by its bytes."""
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "repository", "generation", F.encode(F.coalesce("content", F.lit("")), "UTF-8").alias("bytes"))
    now = table(spark, d, "files").agg(F.max("generation").alias("now"))
    cut = F.decode(F.substring(F.col("bytes"), F.col("start_byte").cast("int") + 1, F.greatest(F.col("end_byte") - F.col("start_byte"), F.lit(0)).cast("int")), "UTF-8")
    s = _distinct(spark, d, "symbols").join(f, "file_id").crossJoin(F.broadcast(now))
    s = s.select("repository", "name", "kind", F.coalesce("parent", F.lit("")).alias("parent"), "signature", X.body_fingerprint(cut, F.col("signature")).alias("body"), (F.col("generation") == F.col("now")).alias("current"))
    return X.symbol_changes(s.filter("not current"), s.filter("current"), ["repository", "name", "kind", "parent"])


@query(None)
def symbol_body_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes by signature and body; ``symbol_changes`` compares signatures only, as its SQL does."""
    return _changed_symbols(spark, d).select("repository", "name", "kind", "parent", "change")


@query(None)
def rename_detection(spark: SparkSession, d: str) -> DataFrame:
    return X.renames(_changed_symbols(spark, d), ["repository", "kind"])


@query(None)
def owner_tests(spark: SparkSession, d: str) -> DataFrame:
    return X.owner_tests(table(spark, d, "files"))


_SIGNED = f"""with t as (select doc_id, unnest(list_filter({_terms('text')}, lambda x: strlen(x) >= 3)) as term from documents), h as (select doc_id, md5(term) as m from t), n as (select doc_id, count(*) as n from h group by 1),
v as (select doc_id, w, b, sum(case when (('0x' || substr(m, 4 * w + 1, 4))::int >> b) & 1 = 1 then 1 else -1 end) as v from h, range(4) r(w), range(16) q(b) group by 1, 2, 3),
s as (select doc_id, w, sum(case when v >= 0 then 1 << b else 0 end)::bigint as x from v group by 1, 2),
signed as (select d.doc_id, case when n >= 3 then (select ('0x' || string_agg(printf('%04x', x), '' order by w))::ubigint from s where s.doc_id = d.doc_id) end as u from documents d left join n on n.doc_id = d.doc_id)"""


@query(
    _SIGNED
    + """, classes as (select u, count(*) as members from signed where u is not null group by 1),
links as (select a.u, count(*) as near from classes a join classes b on a.u <> b.u and bit_count(xor(a.u, b.u)) <= 8 group by 1)
select doc_id, cast(case when s.u >= 9223372036854775808 then s.u::hugeint - 18446744073709551616 else s.u end as bigint) as "class", coalesce(members, 1) as members, coalesce(near, 0) as near_classes from signed s left join classes c on c.u = s.u left join links l on l.u = s.u"""
)
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", J.simhash(T.token_terms("text")).alias("signature"))
    return J.near_duplicate_classes(docs, "doc_id", "signature")


@query(
    f"""with t as (select doc_id, unnest(list_filter({_terms('text')}, lambda x: strlen(x) >= 3)) as term from documents), h as (select doc_id, md5(term) as m from t), n as (select doc_id, count(*) as n from h group by 1),
v as (select doc_id, w, b, sum(case when (('0x' || substr(m, 4 * w + 1, 4))::int >> b) & 1 = 1 then 1 else -1 end) as v from h, range(4) r(w), range(16) q(b) group by 1, 2, 3),
s as (select doc_id, w, sum(case when v >= 0 then 1 << b else 0 end)::bigint as x from v group by 1, 2)
select d.doc_id, case when n >= 3 then (select lower(string_agg(printf('%04x', x), '' order by w)) from s where s.doc_id = d.doc_id) end as signature from documents d left join n on n.doc_id = d.doc_id"""
)
def simhash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lower(F.lpad(F.hex(J.simhash(T.token_terms("text"))), 16, "0")).alias("signature"))


# --- retrieval ---------------------------------------------------------------
@query(f"with t as (select id, unnest({_terms('content')}) as term from {_CHUNKS}) select term, count(distinct id) as df, count(*) as tf from t group by term")
def word_postings(spark: SparkSession, d: str) -> DataFrame:
    return R.term_statistics(N.index_of(spark, d))


_SEARCH_ROWS = ", ".join(f"('{q}', '{t}')" for q, ts in SEARCHES for t in ts)


@query(
    f"""with q(query_id, term) as (values {_SEARCH_ROWS}), d as (select id, {_terms('content')} as words from {_CHUNKS}), n as (select count(*) as n, avg(len(words)) as mean from d),
tf as (select id, term, count(*) as tf, any_value(len) as len from (select id, len(words) as len, unnest(words) as term from d) where term in (select term from q) group by 1, 2), df as (select term, count(*) as df from tf group by 1),
s as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score from tf join df using (term) join q using (term), n group by 1, 2)
select query_id, id as "key", score, position from (select *, row_number() over (partition by query_id order by score desc, id) as position from s) where position <= 20"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame(SEARCHES, "query_id string, terms array<string>")
    return R.bm25(N.index_of(spark, d), q).select("query_id", "key", "score", "position")


@query(f"select id, file_id from {_CHUNKS} where contains(lower(content), 'falls back to a full scan')")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return R.substring_search(N.index_of(spark, d), "Falls back to a FULL scan").select("id", "file_id")


@query(f"select id from {_CHUNKS} where contains(' ' || array_to_string({_terms('content')}, ' ') || ' ', ' holds fewer than ')")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return R.phrase_search(N.index_of(spark, d), "holds fewer than").select("id")


@query(f"select id, file_id from {_CHUNKS} where regexp_matches(content, '(?i){PATTERN}')")
def regex_search(spark: SparkSession, d: str) -> DataFrame:
    return R.regex_search(N.index_of(spark, d), PATTERN, case_sensitive=False).select("id", "file_id")


@query(f"select file_id, count(*) as matches from (select file_id, unnest(regexp_extract_all(content, '[Cc]omputes how many [a-z]+')) from {_CHUNKS}) group by 1")
def occurrence_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.occurrences(_distinct(spark, d, "chunks"), r"[Cc]omputes how many [a-z]+").groupBy("file_id").agg(F.count("*").alias("matches"))


_STATES = "[A-Z][a-z]+(?:State|Store|Pool)"


@query(
    f"""with m as (select id, file_id, start_line, start_byte, regexp_extract_all(content, '\\b{_STATES}\\b') as ms, string_split_regex(content, '\\b{_STATES}\\b') as ps from {_CHUNKS}), k as (select *, unnest(range(1, len(ms) + 1)) as k from m where len(ms) > 0),
p as (select *, ms[k] as "match", array_to_string(list_transform(range(1, k + 1), lambda i: ps[i] || case when i < k then ms[i] else '' end), '') as pre from k)
select id, file_id, start_line + len(string_split(pre, chr(10))) - 1 as line, len(string_split(pre, chr(10))[-1]) + 1 as "column", start_byte + strlen(pre) as start_byte, start_byte + strlen(pre) + strlen("match") as end_byte, "match" from p"""
)
def exhaustive_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return R.occurrences(_distinct(spark, d, "chunks"), rf"\b{_STATES}\b")


@query(f"select id, name, parent, name = 'run' and parent is not null as exact from {_SYMBOLS} where contains(lower(name), 'run')")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return R.symbol_matches(_distinct(spark, d, "symbols"), "run").select("id", "name", "parent", (F.col("exact") & F.col("parent").isNotNull()).alias("exact"))


@query(
    f"""with s as (select s.id, s.start_line as a, s.end_line as b, f.n from {_SYMBOLS} s join (select file_id, max(end_line) as n from chunks group by 1) f on f.file_id = s.file_id), w as (select *, greatest(a - 5, 1) as lo, least(b + 5, n) as hi, greatest(20 - (b - a + 1), 0) as extra from s),
x as (select *, least(a - lo, cast(ceil(extra / 2.0) as bigint)) as b1 from w), y as (select *, least(hi - b, extra - b1) as a1 from x), z as (select *, b1 + least(a - lo - b1, extra - b1 - a1) as b2 from y)
select id, case when hi - lo + 1 <= 20 then lo else a - b2 end as first, case when hi - lo + 1 <= 20 then hi else b + a1 + least(hi - b - a1, extra - b2 - a1) end as last from z"""
)
def excerpt_windows(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "chunks").groupBy("file_id").agg(F.max("end_line").alias("n"))
    s = _distinct(spark, d, "symbols").join(ends, "file_id").withColumn("one", F.lit(1).cast("long"))
    first, last = R.window_around("start_line", "end_line", "one", "n", 5, 20)
    return s.select("id", first.alias("first"), last.alias("last"))


@query(
    f"""with h as (select name as "key", 'definition' as kind, file_id, start_line as line, kind as role from {_SYMBOLS}) select "key", min(struct_pack(path := file_id, line := line)).path as path, min(struct_pack(path := file_id, line := line)).line as line, count(*) as total, list_sort(list_distinct(list(role))) as roles from h group by 1"""
)
def group_hits(spark: SparkSession, d: str) -> DataFrame:
    h = _distinct(spark, d, "symbols").select(F.col("name").alias("key"), F.lit("definition").alias("kind"), F.col("file_id").alias("path"), F.col("start_line").alias("line"), F.col("kind").alias("role"))
    return R.group_hits(h, "key").select("key", F.col("definition.path").alias("path"), F.col("definition.line").alias("line"), "total", "roles")


@query(None)
def fuzzy_find(spark: SparkSession, d: str) -> DataFrame:
    return R.fuzzy_find(table(spark, d, "files"), "tstldgr", 50)


@query(
    """with h as (select repository as path, language as fusion_key, 0.5 as weight, row_number() over (partition by language order by count(*) desc, repository) - 1 as rank from files where language is not null group by 1, 2), s as (select path, fusion_key, max(weight * 60 / (60 + rank + 1)) as s from h group by 1, 2)
select path, count(*) as keys, round(case when count(*) > 1 then least(sum(s) - max(s), 0.2) else 0 end, 6) as boost from s group by 1"""
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "files").filter("language is not null").groupBy(F.col("repository").alias("path"), F.col("language").alias("fusion_key")).agg(F.count("*").alias("n"))
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy("fusion_key").orderBy(F.desc("n"), "path")) - 1).withColumn("weight", F.lit(0.5))
    return R.fusion(ranked).select("path", "keys", F.round("boost", 6).alias("boost"))


@query(f"select count(distinct id) as texts, cast((select count(*) from (select distinct id, unnest({_terms('content')}) as term from {_CHUNKS})) as bigint) as postings, cast((select count(*) from (select distinct id, unnest(list_transform(range(1, length(lower(content)) - 1), lambda i: substring(lower(content), i, 3))) as g from {_CHUNKS})) as bigint) as gram_postings from chunks")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The stored index, built if need be, and what it holds."""
    x = N.index_of(spark, d)
    return x.texts.agg(F.count("*").alias("texts")).crossJoin(x.words.agg(F.count("*").alias("postings"))).crossJoin(x.grams.agg(F.sum(F.size("keys")).cast("long").alias("gram_postings")))


@query(f"with t as (select term, id as key, count(*) as tf, any_value(n) as length from (select id, unnest({_terms('content')}) as term, len({_terms('content')}) as n from {_CHUNKS}) where term in ('cursor', 'ledger', 'overflow') group by 1, 2) select * from t")
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    return N.index_of(spark, d).postings(["cursor", "ledger", "overflow"]).select("term", "key", "tf", "length")


def _search(spark: SparkSession, d: str, text: str, mode: str, **more) -> DataFrame:
    refs = Y.references(table(spark, d, "files")) if H.route(text, mode)[0] in ("identifier", "reference") else None
    return H.search(N.index_of(spark, d), table(spark, d, "symbols"), table(spark, d, "files"), text, mode, references=refs, **more)


_TEXT_HITS = "select f.path, c.start_line + len(string_split(b, chr(10))) - 1 as start_line, 'text' as kind, round(3 + n / (n + 3.0), 6) as score from (select *, {before} as b, {count} as n from " + _CHUNKS + ") c join files f on f.id = c.file_id where n > 0"


@query(_TEXT_HITS.format(before="substr(content, 1, instr(lower(content), 'full scan') - 1)", count="len(string_split(lower(content), 'full scan')) - 1"))
def search_text(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "full SCAN", "text").select("path", "start_line", "kind", F.round("score", 6).alias("score"))


@query(_TEXT_HITS.format(before="string_split_regex(content, '[Cc]omputes how many [a-z]+')[1]", count="len(regexp_extract_all(content, '[Cc]omputes how many [a-z]+'))"))
def search_regex(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "[Cc]omputes how many [a-z]+", "regex", case_sensitive=True).select("path", "start_line", "kind", F.round("score", 6).alias("score"))


@query(f"select path, s.start_line, s.start_byte, case when name = 'run' then 10.0::double else 7.0::double end + case when path like 'atlas-monorepo/%' then 2 else 0 end as score, name from {_SYMBOLS} s join files f on f.id = s.file_id where contains(lower(name), 'run')")
def search_symbol(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "run", "symbol", focus=["atlas-monorepo/**"]).select("path", "start_line", "start_byte", "score", "name")


_CALLS = "(select distinct f.path, l.line, c.name from (select id, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from files where content is not null) l, (select unnest(regexp_extract_all(l.text, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) as name) c join files f on f.id = l.id)"


@query(f"select path, line as start_line, max(case when name = 'run' then 8.0::double else 5.0::double end) as score from {_CALLS} where contains(lower(name), 'run') and name not in ({', '.join(chr(39) + x + chr(39) for x in sorted(Y._CONTROL))}) group by 1, 2")
def search_reference(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "run", "reference").select("path", "start_line", "score")


@query(None)
def search_auto(spark: SparkSession, d: str) -> DataFrame:
    """One word is an identifier: its definitions, calls and texts, merged, first page."""
    return H.ordered(_search(spark, d, "run", "auto", exclude=EXCLUDED), 100)


@query(None)
def search_coverage(spark: SparkSession, d: str) -> DataFrame:
    hits = _search(spark, d, "run", "auto", exclude=EXCLUDED)
    return H.coverage(hits, H.ordered(hits, 100))


# --- ranking and packing -----------------------------------------------------
@query(None)
def task_plan(spark: SparkSession, d: str) -> DataFrame:
    return task_queries(spark, TASKS)


@query(None)
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    x = N.index_of(spark, d)
    return context(spark, TASKS, table(spark, d, "files"), x, table(spark, d, "symbols"), demands=DEMANDS, edges=x.edges, changed=_lately(spark, d))


def _lately(spark: SparkSession, d: str) -> DataFrame:
    """The files that changed in the last seven days of the log and are still there."""
    last = X.latest_changes(table(spark, d, "changes")).filter("kind <> 'deleted'")
    return last.crossJoin(F.broadcast(last.agg(F.max("ts").alias("end")))).filter("ts >= end - interval 7 days").select("path")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    x = N.index_of(spark, d)
    return candidates(task_queries(spark, TASKS), table(spark, d, "files"), x, table(spark, d, "symbols"), demands=DEMANDS, edges=x.edges, changed=_lately(spark, d))


@query(None)
def import_seeds(spark: SparkSession, d: str) -> DataFrame:
    return seed_paths(_candidates(spark, d))


@query(None)
def candidate_signals(spark: SparkSession, d: str) -> DataFrame:
    """For each task and channel: candidates, and of how many each signal is set."""
    c = _candidates(spark, d)
    return c.groupBy("task_id", "representation").agg(F.count("*").alias("candidates"), *[F.sum((F.col(k) != 0).cast("long")).alias(k) for k in K.SIGNALS if k != "size_score"])


@query(None)
def candidate_dedup(spark: SparkSession, d: str) -> DataFrame:
    return K.dedup(_candidates(spark, d))


@query(
    f"""with c as (select c.id, f.path, {_tokens('c.content')} as t, len({_terms('c.content')}) as n, c.start_line from {_CHUNKS} c join files f on f.id = c.file_id)
select id, round(greatest(0.4 * (n / 100.0) / (1 + n / 100.0) + 0.15 / (1 + greatest(t, 1) / 150.0) + (case when start_line = 1 then 1.0 else 0.0 end) - 0.25 * least(greatest(n - 5, 0) / 20.0, 1.0), 0), 6) as score from c"""
)
def linear_score(spark: SparkSession, d: str) -> DataFrame:
    c = _distinct(spark, d, "chunks").withColumn("n", F.size(T.token_terms("content")))
    zero = {k: F.lit(0.0) for k in K.SIGNALS}
    c = c.withColumns(zero | {"bm25": F.col("n") / 100.0, "exact": F.when(F.col("start_line") == 1, 1.0).otherwise(0.0), "lexical_frequency_penalty": F.least(F.greatest(F.col("n") - 5, F.lit(0)) / 20.0, F.lit(1.0)), "token_count": F.greatest(estimate("content"), F.lit(1))})
    return c.select("id", F.round(K.linear_score(), 6).alias("score"))


@query(None)
def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    packed = context_pack(spark, d)
    need = spark.createDataFrame([(1, "path", "atlas-monorepo"), (1, "evidence", "cursor"), (2, "evidence", "ledger"), (3, "evidence", "no such text anywhere")], "task_id long, kind string, value string")
    return K.coverage(packed, need)


@query("with c as (select coalesce('.' || nullif(lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)), ''), '[no extension]') as value, count(*) as n from files group by 1), r as (select *, row_number() over (order by n desc, value) as p, count(*) over () as k from c) select case when k > 12 and p >= 12 then '[other]' else value end as value, cast(sum(n) as bigint) as n from r group by 1")
def omission_facets(spark: SparkSession, d: str) -> DataFrame:
    return A.facets(table(spark, d, "files"), F.coalesce(F.concat(F.lit("."), T.extension("path")), F.lit("[no extension]")))


@query(None)
def outline_pack(spark: SparkSession, d: str) -> DataFrame:
    return K.outline(table(spark, d, "symbols"), 200)


@query(
    "with c as (select distinct path, lower(trim(kind)) as kind, ts from changes where path is not null), l as (select path, arg_max(kind, (ts, kind)) as kind, max(ts) as ts from c group by 1), x as (select path from l where kind <> 'deleted' and ts >= (select max(ts) from l where kind <> 'deleted') - interval 7 days) "
    f"select status, count(*) as paths from (select path, case when {_path_class('path')} <> 'production' then 'unknown' else 'known' end as status from x) group by 1"
)
def changed_classes(spark: SparkSession, d: str) -> DataFrame:
    """Of the files that changed lately those whose owner tests can be told at all."""
    c = G.owner_coverage(_lately(spark, d), X.owner_tests(table(spark, d, "files")))
    return c.groupBy(F.when(F.col("status") == "unknown", "unknown").otherwise("known").alias("status")).agg(F.count("*").alias("paths"))


@query(None)
def owner_coverage(spark: SparkSession, d: str) -> DataFrame:
    return G.owner_coverage(_lately(spark, d), X.owner_tests(table(spark, d, "files")))


@query(None)
def diff_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The files that changed lately, whole, with their symbols, callers, importers and tests."""
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "path", T.line_count("content").cast("long").alias("n"))
    hunks = f.join(_lately(spark, d), "path", "left_semi").select("path", F.lit(1).cast("long").alias("a"), F.greatest("n", F.lit(1)).alias("b"))
    s = _distinct(spark, d, "symbols").join(f, "file_id").select("path", "name", "kind", "start_line", "end_line")
    refs = Y.references(table(spark, d, "files")).join(f.select("file_id", "path"), "file_id").select("path", "line", "name")
    edges = N.index_of(spark, d).edges.select("path", "resolved_path", "line")
    return G.diff_evidence(hunks, s, refs, edges, X.owner_tests(table(spark, d, "files")), table(spark, d, "files"))


@query("select count(*) as files from files where regexp_matches(path, '(?i)\\.(json|toml|ini|cfg|properties|env|conf)$|(^|/)\\.env[\\w.]*$') and content is not null and content <> ''")
def config_files(spark: SparkSession, d: str) -> DataFrame:
    """How many configuration files give settings or are named as not parsing."""
    found = G.settings(table(spark, d, "files").filter("content <> ''"))
    return found.agg(F.countDistinct("path").alias("files"))


# --- structure and serving ---------------------------------------------------
@query(None)
def symbols_extracted(spark: SparkSession, d: str) -> DataFrame:
    return Y.extract_symbols(table(spark, d, "files"))


@query(f"select f.language, count(*) as recorded, count(*) as found from (select distinct file_id, name, kind, start_byte from {_SYMBOLS}) s join files f on f.id = s.file_id group by 1")
def symbols_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Of the symbols that the index records, those that extraction finds at the same byte with the same name and kind: all of them."""
    key = ["file_id", "name", "kind", "start_byte"]
    s = table(spark, d, "symbols").select(*key).distinct()
    found = Y.extract_symbols(table(spark, d, "files")).select(*key).distinct().withColumn("found", F.lit(1))
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "language")
    return s.join(found, key, "left").join(f, "file_id").groupBy("language").agg(F.count("*").alias("recorded"), F.count("found").alias("found"))


@query("with l as (select id as file_id, unnest(string_split(content, chr(10))) as text from files where content is not null), c as (select file_id, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) as name from l) select name, count(*) as calls, count(distinct file_id) as files from c where name not in (" + ", ".join(f"'{x}'" for x in sorted(Y._CONTROL)) + ") group by 1")
def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    return Y.references(table(spark, d, "files")).groupBy("name").agg(F.count("*").alias("calls"), F.countDistinct("file_id").alias("files"))


@query(None)
def reference_enclosing(spark: SparkSession, d: str) -> DataFrame:
    """Call sites with the innermost symbol around their line."""
    r = Y.references(table(spark, d, "files")).distinct().withColumn("point_id", F.concat_ws(":", "line", "name")).withColumn("at", F.col("line"))
    s = _distinct(spark, d, "symbols").select("file_id", F.col("start_line").alias("c"), F.col("end_line").alias("d"), F.struct("start_byte", "id").alias("tie"), F.col("id").alias("symbol_id"))
    return J.narrowest_enclosing(r.select("file_id", "point_id", "at"), s, "file_id").select("file_id", F.col("at").alias("line"), F.regexp_extract("point_id", ":(.*)$", 1).alias("name"), "symbol_id")


@query(None)
def web_outline(spark: SparkSession, d: str) -> DataFrame:
    return Y.web_outline(table(spark, d, "files"))


_ASKED = ["run", "no_such_symbol", "PathStore.run"]


@query(
    f"""with n(wanted) as (values {', '.join(f"('{x}')" for x in _ASKED)}), m as (select wanted, s.id from n left join {_SYMBOLS} s on s.name = regexp_extract(wanted, '([^.]+)$', 1) and (not contains(wanted, '.') or s.parent = regexp_replace(wanted, '[.][^.]+$', '')))
select wanted as name, case count(id) when 0 then 'not_found' when 1 then 'unique' else 'ambiguous' end as status, case when count(id) = 1 then min(id) end as symbol_id from m group by 1"""
)
def symbol_resolution(spark: SparkSession, d: str) -> DataFrame:
    return Y.resolve_symbol(_distinct(spark, d, "symbols"), spark.createDataFrame([(x,) for x in _ASKED], "name string"))


@query("select id, case when not regexp_matches(path, '/(src|lib)/') or regexp_matches(path, '/(vendor|third_party)/') then 'path_excluded' else 'eligible' end as status from files")
def eligibility(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", V.eligibility("path", "content_hash", include=["**/{src,lib}/**"], exclude=EXCLUDED).alias("status"))


@query("with r as (select id as file_id, least(70, n) as a, least(95, n) as b, content from (select *, len(string_split(content, chr(10))) - cast(content like '%' || chr(10) as int) as n from files) where n >= 70) select file_id as request_id, a as first, b as last, md5(array_to_string(string_split(content, chr(10))[a:b], chr(10))) as digest from r")
def stored_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Lines 70 to 95 of all long files, put together from their chunks."""
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), T.line_count("content").alias("n")).filter("n >= 70")
    r = f.select(F.col("file_id").alias("request_id"), "file_id", F.least(F.lit(70), "n").alias("a"), F.least(F.lit(95), "n").alias("b"))
    e = V.stored_excerpts(table(spark, d, "chunks"), r)
    return e.select("request_id", F.least("first", "last").alias("first"), F.col("last"), F.md5(F.regexp_replace("content", r"\n\z", "")).alias("digest"))


# --- aggregates and accounting -----------------------------------------------
@query(f"select kind, count(*) as n, count(distinct file_id) as files from {_SYMBOLS} group by 1")
def symbol_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _distinct(spark, d, "symbols").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


@query(
    """with e as (select distinct repository, substr(md5(path), 1, 3) as b, path || ':' || coalesce(content_hash, '') as e from files where path is not null), l as (select repository, b, count(*) as n, sha256(string_agg(e, chr(10) order by e)) as d from e group by 1, 2)
select repository, cast(sum(n) as bigint) as entries, substr(sha256(string_agg(d, chr(10) order by b)), 1, 32) as digest from l group by 1"""
)
def partition_digest(spark: SparkSession, d: str) -> DataFrame:
    return A.ordered_digest(table(spark, d, "files"), "repository", "path", "content_hash")


@query("select event_type, cast(count(*) as bigint) as requests, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k from events group by 1")
def savings_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), S.pointer_column("props", "/k").cast("long").alias("k"))
    return A.counters(e, ["event_type"], ["cents", "k"])


@query(
    """with h as (select event_type, ts < timestamp '2024-01-16' as early, cast(round(value * 100) as bigint) as cents from events), a as (select event_type, sum(cents) as c, count(*) as n from h group by 1), b as (select event_type, sum(cents) as c, count(*) as n from h where early group by 1)
select event_type, cast(coalesce(a.n, 0) - coalesce(b.n, 0) as bigint) as requests, cast(coalesce(a.c, 0) - coalesce(b.c, 0) as bigint) as cents, coalesce(a.n, 0) < coalesce(b.n, 0) or coalesce(a.c, 0) < coalesce(b.c, 0) as regressed from a full join b using (event_type)"""
)
def savings_delta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    early = e.filter(F.col("ts") < F.to_timestamp(F.lit("2024-01-16")))
    now, base = A.counters(e, ["event_type"], ["cents"]), A.counters(early, ["event_type"], ["cents"])
    return A.counter_delta(now, base, ["event_type"], ["requests", "cents"])


@query(f"select file_id, case when count(token_count) = count(*) then cast(sum(token_count) as bigint) end as baseline_tokens from {_CHUNKS} group by 1")
def whole_file_baseline(spark: SparkSession, d: str) -> DataFrame:
    return A.baseline_tokens(_distinct(spark, d, "chunks").withColumn("tokenizer", F.lit("estimate")), "file_id", "tokenizer", "token_count")


@query(
    """with p as (select distinct path from changes where path is not null), g as (select case when len(string_split(path, '/')) > 2 then array_to_string(string_split(path, '/')[1:2], '/') when contains(path, '/') then string_split(path, '/')[1] else '.' end as path_group, count(*) as paths from p group by 1)
select path_group, paths, sum(paths) over () >= 32 and count(*) over () >= 3 and max(paths) over () >= 0.5 * sum(paths) over () as routed from g"""
)
def path_groups(spark: SparkSession, d: str) -> DataFrame:
    return A.routing_groups(table(spark, d, "changes").filter("path is not null"), "path")


@query(
    """with d as (select distinct revision, repository, language, source_shape, counts from parse_diagnostics), t as (select repository, language, cast(sum(counts.files) as bigint) as reported, cast(sum(counts.incomplete_files) as bigint) as reported_incomplete from d group by 1, 2),
f as (select repository, language, count(*) as files, sum(cast(not structurally_complete as int)) as incomplete from files where language is not null group by 1, 2)
select repository, language, files, reported, case when reported is null then 'unavailable' when files is null then 'unavailable' when files = reported and incomplete = reported_incomplete then 'exact' else 'proxy' end as verdict from f full join t using (repository, language)"""
)
def diagnostic_audit(spark: SparkSession, d: str) -> DataFrame:
    """Reported totals held against recomputed ones."""
    p = table(spark, d, "parse_diagnostics").select("revision", "repository", "language", "source_shape", "counts").distinct().groupBy("repository", "language").agg(F.sum("counts.files").alias("reported"), F.sum("counts.incomplete_files").alias("reported_incomplete"))
    f = table(spark, d, "files").filter("language is not null").groupBy("repository", "language").agg(F.count("*").alias("files"), F.sum((~F.col("structurally_complete")).cast("long")).alias("incomplete"))
    verdict = F.when(F.col("reported").isNull() | F.col("files").isNull(), "unavailable").when((F.col("files") == F.col("reported")) & (F.col("incomplete") == F.col("reported_incomplete")), "exact").otherwise("proxy")
    return f.join(p, ["repository", "language"], "full").select("repository", "language", "files", "reported", verdict.alias("verdict"))


@query("select event_type, case when value is null then 'unclassified' when event_type = 'error' then 'failed' when value >= 100 then 'useful' else 'incomplete' end as class, count(*) as n from events group by 1, 2")
def request_classes(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("value").isNull(), "unclassified").when(F.col("event_type") == "error", "failed").when(F.col("value") >= 100, "useful").otherwise("incomplete")
    return table(spark, d, "events").groupBy("event_type", c.alias("class")).agg(F.count("*").alias("n"))


# --- JSON --------------------------------------------------------------------
@query("with k as (select event_type, cast(json_extract_string(props, '$.k') as double) as k from events) select event_type, count(k) as count, cast(count(*) - count(k) as bigint) as non_numeric, min(k) as min, quantile_cont(k, 0.5) as median, quantile_disc(k, 0.95) as p95, max(k) as max from k group by 1")
def numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.numeric_summary(table(spark, d, "events").withColumn("k", S.pointer_column("props", "/k")), ["event_type"], "k")


@query("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.none') is null as missing from events")
def json_pointer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.pointer_column("props", "/k").alias("k"), S.pointer_column("props", "/none").isNull().alias("missing"))


@query("with e as (select user_id, event_type, json_extract_string(props, '$.k') as k, row_number() over (partition by user_id, event_type order by ts, event_id) as a, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as z from events) select f.user_id, f.event_type, '/k' as pointer, f.k as old, l.k as new, case when f.k = l.k then 'same' else 'changed' end as status from e f join e l on f.user_id = l.user_id and f.event_type = l.event_type and f.a = 1 and l.z = 1")
def json_field_diff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "props")
    keys = ["user_id", "event_type"]
    first = e.groupBy(*keys).agg(F.min_by("props", F.struct("ts", "event_id")).alias("props"))
    last = e.groupBy(*keys).agg(F.max_by("props", F.struct("ts", "event_id")).alias("props"))
    return S.field_diff(first, last, keys, "props", ["/k"])


def _json_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").filter(T.extension("path") == "json").select("id", "content")


@query(None)
def json_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.project(_json_files(spark, d), "content", "keys", S.keys).select("id", "keys")


@query(None)
def json_schema(spark: SparkSession, d: str) -> DataFrame:
    return S.project(_json_files(spark, d), "content", "schema", lambda v: S.schema(v, 200)).select("id", "schema")


@query(None)
def json_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return S.project(_json_files(spark, d), "content", "collapsed", lambda v: S.collapse(v, 200, 3)[0]).select("id", "collapsed")


# --- receipts and streams ----------------------------------------------------
def _requests(spark: SparkSession, d: str) -> DataFrame:
    """The chunks as requests of their repository's session, in the order of their ids."""
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "repository", "path")
    c = _distinct(spark, d, "chunks").select("id", "file_id", F.col("start_line").alias("a"), F.col("end_line").alias("b"), T.fingerprint("content").alias("content_hash"), J.simhash(T.token_terms("content")).alias("signature"))
    return c.join(f, "file_id").select(F.col("repository").alias("session"), F.col("id").alias("position"), "path", "a", "b", "content_hash", "signature")


@query(
    """with r as (select f.repository as session, c.id as position, f.path, c.start_line as a, c.end_line as b, substr(sha256(c.content), 1, 32) as h from (select distinct on (id) * from chunks) c join files f on f.id = c.file_id), e as (select session, h, min(position) as p from r group by 1, 2),
o as (select distinct x.session, x.position from r x join r y on x.session = y.session and x.path = y.path and x.a <= y.b and y.a <= x.b and y.position < x.position)
select r.session, r.position, case when e.p < r.position then 'exact' when o.position is not null then 'overlap' else 'return' end as decision from r join e on e.session = r.session and e.h = r.h left join o on o.session = r.session and o.position = r.position"""
)
def receipt_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by hash and range alone, as its SQL has them; ``receipt_near_decisions`` also tells near duplicates."""
    return P.decisions(_requests(spark, d).drop("signature"))


@query(None)
def receipt_near_decisions(spark: SparkSession, d: str) -> DataFrame:
    return P.decisions(_requests(spark, d))


@query(
    """with c as (select distinct on (id) * from chunks), x as (select c.id, f.id as f, c.content, array_to_string(string_split(f.content, chr(10))[c.start_line:c.end_line], chr(10)) as cut from c left join files f on f.id = c.file_id)
select id as evidence_id, case when f is null then 'missing' when content = '' or cut = regexp_replace(content, chr(10) || '$', '') then 'carried' else 'changed' end as outcome from x"""
)
def receipt_rebase(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "path", "content")
    e = _distinct(spark, d, "chunks").select(F.col("id").alias("evidence_id"), "file_id", F.col("start_line").alias("a"), F.col("end_line").alias("b"), "content")
    e = e.join(f.select("file_id", "path"), "file_id", "left")
    return P.rebase(e.select("evidence_id", "path", "a", "b", "content"), f.select("path", "content"))


_BURSTS = """with c as (select string_split(path, '/')[1] as repository, ts from changes where path is not null and ts is not null), g as (select *, case when ts <= lag(ts) over w + interval 500 milliseconds - interval 1 microsecond then 0 else 1 end as fresh from c window w as (partition by repository order by ts)),
s as (select *, sum(fresh) over (partition by repository order by ts rows between unbounded preceding and current row) as n from g) select repository, min(ts) as started, max(ts) as ended, count(*) as events, 'paths' as action from s group by repository, n"""


@query(_BURSTS)
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    return C.bursts(table(spark, d, "changes"))


@query(None)
def debounce_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The bursts with duplicate deliveries counted once; ``debounce_sessions`` and ``stream_debounce`` count them as their SQL does."""
    return C.bursts(table(spark, d, "changes"), once=True)


@query(_BURSTS)
def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    return C.stream_bursts(spark, d)


@query("select event_type, date_trunc('hour', ts) as window_start, count(*) as n, round(sum(value), 2) as value from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.event_windows(table(spark, d, "events"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registry.items() if sql}


__all__ = ["queries", "oracle_sql"]
