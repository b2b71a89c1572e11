"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base findings stand for themselves: assignments (``password = ...``), access identifiers and
long hexadecimal runs. Weak findings (a 40-character key, a user name, an endpoint) mean
little alone; each is reported only when its complementary parts lie in its *scope*, the
findings of the same text whose start is at most ``scope`` code points away:

    secret    a key-like run of 40 characters, with an identifier in scope
    ident     a user or client name, with a secret in scope
    endpoint  the address of a service, with both an identifier and a secret in scope

Identifiers are ``access`` and ``ident`` findings, secrets are ``assign``, ``hex`` and
``secret`` findings. The link is an interval join: the text is cut into cells of ``scope``
code points; per cell and role only the first and the last start are kept, which decide
whether a part lies in scope of a finding of the same or a neighbouring cell. So a finding
meets at most three rows a role, however many parts a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, let, materialize

#: The patterns, the group that holds the value and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KEY40 = r"[A-Za-z0-9+/]{40,}"
IDENT = r"""(?i:user_?name|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"

KINDS = ("assign", "access", "hex", "secret", "ident", "endpoint")
IDENTIFIERS, SECRETS = ("access", "ident"), ("assign", "hex", "secret")
_SPANS = "array<struct<start:int,end:int>>"
_CHUNK = 512


def _no_spans() -> Column:
    return F.array().cast(_SPANS)


def positions(text: Column, regex: str, fits=None) -> Column:
    """Spans (start, end in code points) of the leftmost non-overlapping matches.

    The text between the matches and the matches themselves give the positions as running
    sums, summed in chunks so that a text full of matches doesn't copy ever longer arrays; a
    chunk starts from the sums of the chunks before it.
    fits(match): which matches count.
    """

    def sums(steps: Column) -> Column:
        width = lambda a, s: a + s["gap"] + s["size"]

        def chunk(before: Column, c: Column) -> Column:
            base = F.aggregate(F.slice(before, F.lit(1), c), F.lit(0), lambda a, n: a + n)
            start = F.struct(base.alias("at"), _no_spans().alias("out"))
            add = lambda a, s: F.struct(width(a["at"], s).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), width(a["at"], s).alias("end")))).alias("out"))
            return F.aggregate(F.slice(steps, c * _CHUNK + 1, _CHUNK), start, add, lambda a: a["out"])

        chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int"))
        sizes = F.transform(chunks, lambda c: F.aggregate(F.slice(steps, c * _CHUNK + 1, _CHUNK), F.lit(0), width))
        return F.flatten(let(sizes, lambda before: F.transform(chunks, lambda c: chunk(before, c))))

    def located(matches: Column) -> Column:
        gaps = lambda pieces: F.transform(matches, lambda m, i: F.struct(F.char_length(F.get(pieces, i)).alias("gap"), F.char_length(m).alias("size")))
        spans = let(let(F.split(text, regex, -1), gaps), sums)
        return F.filter(spans, lambda _, i: fits(F.get(matches, i))) if fits else spans

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda m: F.when(F.size(m) > 0, located(m)).otherwise(_no_spans()))


def _where(condition: Column, spans: Column) -> Column:
    """Spans only of texts that can hold some: the condition is cheap and never misses one."""
    return F.when(condition, spans).otherwise(_no_spans())


def _has(low: Column, *literals: str) -> Column:
    out = F.contains(low, F.lit(literals[0]))
    for x in literals[1:]:
        out = out | F.contains(low, F.lit(x))
    return out


def _key_like(m: Column) -> Column:
    return (F.char_length(m) == 40) & m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")


def findings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, row (a hash of the text) and the spans of each kind, all weak ones
    included; key-like runs that overlap a base finding are part of that."""
    t, low = F.col("_t"), F.col("_low")
    long_value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.withColumn("_low", F.lower("_t"))
    rows = rows.select(
        "doc_id",
        F.xxhash64("_t").alias("row"),
        _where(_has(low, "password", "passwd", "secret", "token", "api"), positions(t, ASSIGN, long_value)).alias("assign"),
        _where(F.contains(t, F.lit("AKIA")), positions(t, ACCESS)).alias("access"),
        positions(t, HEX).alias("hex"),
        positions(t, KEY40, _key_like).alias("key40"),
        _where(_has(low, "user", "login", "client", "account"), positions(t, IDENT)).alias("ident"),
        _where(F.contains(t, F.lit("://")), positions(t, ENDPOINT)).alias("endpoint"),
    )
    base = F.concat("assign", "access", "hex")
    apart = F.filter("key40", lambda k: ~F.exists(base, lambda b: (b["start"] < k["end"]) & (k["start"] < b["end"])))
    return rows.withColumn("secret", apart).drop("key40")


def _of_kind(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def linked(found: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, row, kind, start, end of the weak findings whose complementary parts are in scope."""
    some = " or ".join(f"size({k}) > 0" for k in ("secret", "ident", "endpoint"))
    parts = found.where(some).select("doc_id", "row", F.explode(F.concat(*(_of_kind(k) for k in KINDS))).alias("p"))
    parts = parts.select("doc_id", "row", "p.*").withColumn("cell", F.floor(F.col("start") / scope).cast("int"))
    role = F.when(F.col("kind").isin(*IDENTIFIERS), "identifier").when(F.col("kind").isin(*SECRETS), "secret")
    cells = parts.where(F.col("kind") != "endpoint").groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("cell").alias("there"), role.alias("role")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = parts.where(F.col("kind").isin("secret", "ident", "endpoint")).distinct().withColumn("near", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    met = weak.join(cells, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")) & (F.col("near") == F.col("there")))
    before = (F.col("there") < F.col("cell")) & (F.col("last") >= F.col("start") - scope)
    after = (F.col("there") > F.col("cell")) & (F.col("first") <= F.col("start") + scope)
    met = met.where((F.col("there") == F.col("cell")) | before | after)
    seen = met.groupBy("doc_id", "row", "kind", "start", "end").agg(F.max(F.col("role") == "identifier").alias("with_identifier"), F.max(F.col("role") == "secret").alias("with_secret"))
    fits = F.when(F.col("kind") == "secret", F.col("with_identifier")).when(F.col("kind") == "ident", F.col("with_secret")).otherwise(F.col("with_identifier") & F.col("with_secret"))
    return seen.where(fits).select("doc_id", "row", "kind", "start", "end")


def _marked(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def named(spans: Column) -> Column:
    """kind:start:end of spans (start, kind number, end) by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, scope: int = 400, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, base and added: arrays of (start, kind number, end), for every row of docs.

    Null texts are empty. Null ids and repeated rows stay; rows of one id are scanned by their
    own texts (row is a hash of it). Other columns of docs are ignored.
    """
    found = materialize(findings(docs, id, text), "findings")
    more = linked(found, scope).groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_set(F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("kind"), "end")).alias("added"))
    more = more.withColumn("added", F.transform("added", lambda s: F.struct(s["start"].alias("start"), (s["kind"] - 1).alias("kind"), s["end"].alias("end"))))
    base = F.concat(*(_marked(F.col(k), k) for k in KINDS[:3]))
    rows = found.select("doc_id", "row", base.alias("base"))
    joined = rows.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    return joined.select("doc_id", "row", "base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


def stretches(found: DataFrame) -> DataFrame:
    """doc_id, row and the stretches (from, to) that the spans of each text cover, ascending; spans
    that overlap or touch are one. A span begins a stretch if it starts behind all ends so far."""
    spans = found.select("doc_id", "row", F.array_distinct(F.concat("base", "added")).alias("spans")).where("size(spans) > 0")
    each = spans.groupBy("doc_id", "row").agg(F.first("spans").alias("spans")).select("doc_id", "row", F.inline("spans"))
    in_order = Window.partitionBy("doc_id", "row").orderBy("start", "end")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = each.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    numbered = fresh.withColumn("n", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = numbered.groupBy("doc_id", "row", "n").agg(F.min("start").alias("from"), F.max("end").alias("to"))
    return whole.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("stretches"))


def redact(docs: DataFrame, scope: int = 400, mask: str = "[REDACTED]", id: str = "doc_id", text: str = "text", few: int = 64) -> DataFrame:
    """docs with every finding in the text replaced by the mask; findings that overlap or touch
    are one. Rows, ids and all other columns stay; a null text stays null.

    A text with up to ``few`` stretches is cut by substrings, each of which walks from the text's
    start; one with more by its characters, so that a text full of findings takes linear time.
    """
    d, r, cuts = (free_name(docs.columns, c) for c in ("_d", "_r", "_cuts"))
    found = stretches(scan(docs, scope, id, text)).select(F.col("doc_id").alias(d), F.col("row").alias(r), F.col("stretches").alias(cuts))
    joined = docs.join(found, F.col(id).eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(r)), "left")
    whole = F.col(text)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["to"])
    end = F.element_at(cuts, -1)["to"]
    short = F.concat(F.array_join(F.transform(cuts, lambda s, i: F.substring(whole, begin(i) + 1, s["from"] - begin(i))), mask), F.lit(mask), F.substring(whole, end + 1, F.lit(2**31 - 1)))

    def by_characters(c: Column) -> Column:
        kept = F.transform(cuts, lambda s, i: F.array_join(F.slice(c, begin(i) + 1, s["from"] - begin(i)), ""))
        return F.concat(F.array_join(kept, mask), F.lit(mask), F.array_join(F.slice(c, end + 1, F.size(c)), ""))

    long = let(F.regexp_extract_all(whole, F.lit("(?s)."), F.lit(0)), by_characters)
    masked = F.when(F.col(cuts).isNull(), whole).when(F.size(cuts) <= few, short).otherwise(long)
    return joined.withColumn(text, masked).select(*docs.columns)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Findings of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.concat("base", "added")).alias("spans"))


def _duck_spans(regex: str, fits: str = "true") -> str:
    """SQL for the spans of a pattern: running sums over the pieces between the matches."""
    r = "'" + regex.replace("'", "''") + "'"
    return (
        f"(SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER), 'm': m[i]}}), lambda y: {fits})"
        f" FROM (SELECT regexp_extract_all(t, {r}) AS m, string_split_regex(t, {r}) AS p))"
    )


OP7_SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
    "f AS (SELECT doc_id, "
    + ", ".join(
        f"{_duck_spans(r, fits)} AS {k}"
        for k, r, fits in (
            ("assign", ASSIGN, "length(regexp_extract(y.m, '" + ASSIGN.replace("'", "''") + "', 2)) >= 8"),
            ("access", ACCESS, "true"),
            ("hex", HEX, "true"),
            ("key40", KEY40, "length(y.m) = 40 AND regexp_matches(y.m, '[0-9]') AND regexp_matches(y.m, '[A-Z]') AND regexp_matches(y.m, '[a-z]')"),
            ("ident", IDENT, "true"),
            ("endpoint", ENDPOINT, "true"),
        )
    )
    + " FROM t), "
    + "x AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS o, unnest({c}).s AS s, unnest({c}).s + length(unnest({c}).m) AS e FROM f" for i, (k, c) in enumerate((("assign", "assign"), ("access", "access"), ("hex", "hex"), ("secret", "key40"), ("ident", "ident"), ("endpoint", "endpoint"))))
    + "), "
    "y AS (SELECT * FROM x WHERE kind <> 'secret' OR NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = x.doc_id AND b.o < 3 AND b.s < x.e AND x.s < b.e)), "
    "z AS (SELECT *, EXISTS (SELECT 1 FROM y i WHERE i.doc_id = y.doc_id AND i.kind IN ('access', 'ident') AND abs(i.s - y.s) <= 400) AS wi, "
    "EXISTS (SELECT 1 FROM y i WHERE i.doc_id = y.doc_id AND i.kind IN ('assign', 'hex', 'secret') AND abs(i.s - y.s) <= 400) AS ws FROM y), "
    "k AS (SELECT * FROM z WHERE o < 3 OR kind = 'secret' AND wi OR kind = 'ident' AND ws OR kind = 'endpoint' AND wi AND ws), "
    "a AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, "
    "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) FILTER (o < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS spans FROM k GROUP BY doc_id) "
    "SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, "
    "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (doc_id)"
)
