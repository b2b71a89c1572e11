"""URL filters: pattern rules indexed by their rarest literal token.

A rule's pattern is matched against the subject ``host + path`` of a URL (scheme, query and
fragment removed, host lower-cased). Syntax: ``||`` at the start anchors at the host or at any
parent domain of it, ``|`` at the start or the end anchors there, ``*`` stands for any text,
``^`` for one separator or the end; all else is literal.

A *token* is a maximal run of ``[A-Za-z0-9%]``. A token of a pattern is usable when both its
ends are fixed by the pattern, so that every subject the pattern matches has that very token.
Each rule is filed under the usable token that is rarest in the URLs at hand (counted over all
of them); a URL looks up its own tokens and only the rules found there run their regular
expressions. Rules without a usable token are tried on every URL.

Up to ``max_local_rules`` rules the index travels with the task (its size is then bounded);
beyond that, the index is a table joined on the token.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, struct_of

TOKEN = "[A-Za-z0-9%]+"
_TOKEN = re.compile(TOKEN)
#: Where rules are joined: shares of a token's URLs, and rules without a token that are tried at a time.
SHARES, MOST_LOOSE = 16, 10_000


@dataclass(frozen=True)
class Rule:
    """tier: a higher tier goes before any lower one; in a tier the longest name wins, then
    block before allow, then the smaller name."""

    name: str
    verdict: str
    pattern: str
    tier: int = 0

    def rank(self) -> tuple:
        return (self.tier, len(self.name), self.verdict == "block", [-ord(c) for c in self.name])


def site_rule(verdict: str, host: str, path: str, tier: int = 1) -> Rule:
    """A rule for a host, its subdomains and a path prefix."""
    return Rule(host + path, verdict, f"||{host}{path}", tier)


def to_regex(pattern: str, end: str = r"\Z") -> str:
    """The pattern as a regular expression; ``end`` is how its dialect writes the very end of a
    text (a ``$`` would also match before a final line break)."""
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        head, body = r"^(?:[^/]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = end, body[:-1]
    # what is free at an end needn't be matched, which would take quadratic time on long texts
    body = body.lstrip("*") if not head else body
    body = body.rstrip("*") if not tail else body
    parts = {"*": r"[\s\S]*", "^": rf"(?:[^A-Za-z0-9%_.-]|{end})"}
    return head + "".join(parts.get(c) or (c if c.isalnum() and c.isascii() else re.escape(c)) for c in body) + tail


def usable_tokens(pattern: str) -> list[str]:
    """Tokens that every matching subject holds whole."""
    start = 2 if pattern.startswith("||") else 1 if pattern.startswith("|") else 0
    end = len(pattern) - 1 if pattern.endswith("|") and len(pattern) > start else len(pattern)
    found = []
    for m in _TOKEN.finditer(pattern, start, end):
        left = m.start() > start and pattern[m.start() - 1] != "*" or m.start() == start and start > 0
        right = m.end() < end and pattern[m.end()] != "*" or m.end() == end and end < len(pattern)
        if left and right:
            found.append(m.group())
    return found


def with_subject(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path. A null URL, or one without ``://``, has both empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.regexp_replace(u, r"^[\s\S]*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"path": path, "host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")})


def token_counts(subjects: DataFrame, wanted: Iterable[str]) -> dict[str, int]:
    """How many URLs hold each wanted token; the answer is bounded by the rules' tokens."""
    keep = frozenset(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        for batch in batches:
            for s in batch.column(0).to_pylist():
                for t in keep.intersection(_TOKEN.findall(s or "")):
                    n[t] = n.get(t, 0) + 1
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    seen = subjects.select(F.concat("host", "path").alias("s")).mapInArrow(count, struct_of(("token", T.StringType()), ("n", T.LongType())))
    return {t: 0 for t in keep} | {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """token -> rules filed under it, and the rules that no token finds."""
    index: dict[str, list[Rule]] = {}
    rest = []
    for rule in rules:
        tokens = usable_tokens(rule.pattern)
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(rule)
        else:
            rest.append(rule)
    return index, rest


class Matcher:
    """The index in a task."""

    def __init__(self, index: dict[str, list[Rule]], rest: list[Rule]):
        ready = lambda rules: [(re.compile(to_regex(r.pattern)), r) for r in rules]
        self.index = {t: ready(rules) for t, rules in index.items()}
        self.rest = ready(rest)
        self.tried = 0

    def best(self, subject: str) -> dict[int, Rule]:
        """The winning rule of each tier."""
        found: dict[int, Rule] = {}
        own = [self.index[t] for t in set(_TOKEN.findall(subject)) if t in self.index]
        for rules in (*own, self.rest):
            for regex, rule in rules:
                self.tried += 1
                if regex.search(subject) and (rule.tier not in found or rule.rank() > found[rule.tier].rank()):
                    found[rule.tier] = rule
        return found


def judge(urls: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", max_local_rules: int = 100_000) -> DataFrame:
    """Adds host, path, rule (the winning rule's name), tier and verdict to every row.

    Null, empty and malformed URLs get empty host and path and are judged like any other;
    repeated rows are judged alike; an empty table gives an empty result. Columns of urls
    named like an output column (in whatever case) are replaced. Any number of rules is taken: up to
    max_local_rules they go along with the tasks, more of them are joined.
    """
    urls = urls.drop(*[c for c in urls.columns if c.lower() in ("host", "path", "rule", "tier", "verdict") and c != url])
    subjects = with_subject(urls, url)
    counts = token_counts(subjects, {t for r in rules for t in usable_tokens(r.pattern)})
    index, rest = build_index(rules, counts)
    if len(rules) > max_local_rules:
        return _judge_by_join(subjects, index, rest, default)
    schema = T.StructType([*subjects.schema.fields, T.StructField("rule", T.StringType()), T.StructField("tier", T.IntegerType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(index, rest)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            won = [matcher.best(h + p) for h, p in zip(hosts, paths, strict=True)]
            top = [w[max(w)] if w else None for w in won]
            columns = [*batch.columns, pa.array([r and r.name for r in top], pa.string()), pa.array([r and r.tier for r in top], pa.int32()), pa.array([r.verdict if r else default for r in top], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return subjects.mapInArrow(run, schema)


def _judge_by_join(subjects: DataFrame, index: dict[str, list[Rule]], rest: list[Rule], default: str) -> DataFrame:
    """As judge(), for rule sets too large to travel with a task."""
    spark = subjects.sparkSession
    java = lambda r: to_regex(r.pattern, r"\z")
    listed = [(t, java(r), r.name, r.verdict, r.tier, len(r.name), int(r.verdict == "block")) for t, rules in index.items() for r in rules]
    listed += [(None, java(r), r.name, r.verdict, r.tier, len(r.name), int(r.verdict == "block")) for r in rest]
    table = spark.createDataFrame(listed, "token string, regex string, rule string, verdict string, tier int, size int, blocks int")
    # equal subjects are judged once; a frequent token's subjects are dealt out, its rules go to all shares
    subject = subjects.select(F.concat("host", "path").alias("s")).distinct()
    tokens = F.array_distinct(F.regexp_extract_all("s", F.lit(TOKEN), F.lit(0)))
    looked = subject.select("s", F.pmod(F.xxhash64("s"), F.lit(SHARES)).cast("int").alias("share"), F.explode(tokens).alias("token"))
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    filed = table.where("token is not null").select("*", shares)
    found = looked.join(filed, ["token", "share"]).where(F.expr("s rlike regex")).drop("token", "share")
    for i in range(0, len(rest), MOST_LOOSE):  # rules without a token are tried on every subject, a block of bounded size at a time
        block = spark.createDataFrame(listed[len(listed) - len(rest) + i :][:MOST_LOOSE], table.schema).drop("token")
        found = found.unionByName(subject.join(F.broadcast(block), F.expr("s rlike regex")))
    # tier, then the longer name, block first, then the smaller name
    order = F.struct(-F.col("tier"), -F.col("size"), -F.col("blocks"), F.col("rule"))
    best = found.groupBy("s").agg(F.min_by(F.struct("rule", "tier", "verdict"), order).alias("won"))
    won = free_name(subjects.columns, "_won")
    out = subjects.join(best.select(F.col("s").alias(won + "s"), F.col("won").alias(won)), F.concat("host", "path") == F.col(won + "s"), "left")
    return out.select(*subjects.columns, F.col(f"{won}.rule").alias("rule"), F.col(f"{won}.tier").alias("tier"), F.coalesce(F.col(f"{won}.verdict"), F.lit(default)).alias("verdict"))


#: The site rules of the op6 query (verdict, host, path).
SITE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: The method's own rules, for URLs that no site rule fits.
PATTERN_RULES = [
    Rule("ad-server", "block", "||ads."),
    Rule("ad-path", "block", "/ads/"),
    Rule("casino", "block", "/casino/"),
    Rule("login", "block", "/login|"),
    Rule("executable", "block", ".exe|"),
]


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdict for each row of pages; html is never read."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge(pages, [*(site_rule(*r) for r in SITE_RULES), *PATTERN_RULES])
    own = F.col("tier") == 1
    return judged.select("page_id", "host", "path", F.when(own, F.col("rule")).alias("rule"), "verdict", F.when(~own, F.col("rule")).alias("pattern_rule"))


OP6_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM s JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY page_id),
w AS (SELECT *, host || path AS t FROM s),
o AS (SELECT page_id, host, path, CASE WHEN ends_with(t, '.exe') THEN 'executable' WHEN regexp_matches(t, '^([^/]*\.)?ads\.') THEN 'ad-server'
  WHEN contains(t, '/ads/') THEN 'ad-path' WHEN contains(t, '/casino/') THEN 'casino' WHEN ends_with(t, '/login') THEN 'login' END AS own FROM w)
SELECT o.page_id, o.host, o.path, m.rule, coalesce(m.verdict, CASE WHEN own IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN m.rule IS NULL THEN own END AS pattern_rule
FROM o LEFT JOIN m USING (page_id)
"""
