"""URL filters (operator 8): domain rules, and pattern rules indexed by their rarest literal token.

A pattern rule is a text with ``||`` (start of a host label), ``|`` (start or end), ``^`` (a separator) and ``*`` (anything),
with ``@@`` in front if it allows. Its literal tokens are the runs of letters and digits that can only match whole tokens of
a URL. Each rule is filed under the one of its tokens that is rarest among all URLs; a URL's tokens fetch the rules filed
under them, and regular expressions run for those alone. An allowing pattern wins over blocking ones; without any match a URL
is allowed. Domain rules (host and path prefix) come first, the longest that fits wins.

The rule lists are parameters and held to MAX_RULES, so what goes to the executors is bounded whatever the input; token counts
are gathered for the rules' tokens only.

Defined cases: a null URL or one without ``://`` has empty host and path and no domain rule; it is still judged by the
patterns, a null one as an empty URL; repeated rows are judged each; an empty table gives no rows; other columns are never
touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.llm.common import small_batches

MAX_RULES = 200_000
_TOKEN = re.compile(r"[a-z0-9]{2,}")
_AUTHORITY = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOMAIN_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
PATTERNS = (
    "||casino-win.", "||free-bets.", "||cheap-pills.", "||ads-track.", "||adult-x.", "||spam-farm.",
    "/banner/*/click^", "^adclick^", "/popunder^", "@@||example.org^*^help^",
)


def read_rules(text: str) -> tuple[tuple[tuple[str, str], ...], tuple[str, ...]]:
    """Domain rules and patterns of a rule list: a line is a pattern, or ``block host/path`` or ``allow host/path``; empty
    lines and those that begin with ``!`` or ``#`` say nothing, and a line that comes again counts once."""
    domains, patterns = {}, {}
    for line in text.splitlines():
        line = line.strip()
        verdict, _, rest = line.partition(" ")
        if verdict in ("block", "allow") and "/" in rest:
            domains[verdict, rest.strip()] = None
        elif line and line[0] not in "!#":
            patterns[line] = None
    return tuple(domains), tuple(patterns)


@dataclass(frozen=True)
class Pattern:
    text: str
    allow: bool
    regex: str
    tokens: tuple[str, ...]


def parse_pattern(text: str) -> Pattern:
    """The regular expression of a pattern and the tokens that every URL it matches holds whole."""
    allow = text.startswith("@@")
    body = text[2:].lower() if allow else text.lower()
    head, tail = "", ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    regex = "".join(".*" if c == "*" else r"([^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body)
    tokens = []
    for m in _TOKEN.finditer(body):
        left = body[m.start() - 1] if m.start() else "|" if head else "*"
        right = body[m.end()] if m.end() < len(body) else "|" if tail else "*"
        if left != "*" and right != "*":
            tokens.append(m[0])
    return Pattern(text, allow, head + regex + tail, tuple(dict.fromkeys(tokens)))


def url_tokens(url: str) -> list[str]:
    return _TOKEN.findall(url)


class RuleIndex:
    """Pattern rules by their rarest token, domain rules by host."""

    def __init__(self, domain_rules: tuple, patterns: tuple[str, ...], counts: dict[str, int]):
        self.domains: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in domain_rules:
            host, _, path = rule.partition("/")
            self.domains.setdefault(host, []).append((f"/{path}", verdict, rule))
        self.by_token: dict[str | None, list[tuple[bool, re.Pattern]]] = {}
        self.tried = 0  # regular expressions that were run
        for p in map(parse_pattern, patterns):
            key = min(p.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if p.tokens else None
            self.by_token.setdefault(key, []).append((p.allow, re.compile(p.regex, re.S)))

    def domain(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        at = 0
        while host:
            for start, verdict, rule in self.domains.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[1])):
                    best = verdict, rule
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return best

    def pattern(self, url: str) -> str:
        verdict = "allow"
        for key in (None, *dict.fromkeys(url_tokens(url))):
            for allow, regex in self.by_token.get(key, ()):
                if allow or verdict == "allow":
                    self.tried += 1
                    if regex.search(url):
                        if allow:
                            return "allow"
                        verdict = "block"
        return verdict

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        m = _AUTHORITY.search(url or "")
        host, path = (m[1].translate(_LOWER), m[2]) if m else ("", "")
        found = self.domain(host, path)
        return host, path, found[1] if found else None, found[0] if found else self.pattern((url or "").translate(_LOWER))


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; bounded by the rules, whatever the number of URLs."""
    words = F.explode(F.array_intersect(F.split(F.lower("url"), "[^a-z0-9]+"), F.array(*map(F.lit, sorted(tokens)))))
    return {r.t: r.n for r in urls.where("url is not null").select(words.alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()} if tokens else {}


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(*shared.value)
        for b in batches:
            got = [index.judge(u) for u in b.column("url").to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *cols], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, domain_rules: tuple = DOMAIN_RULES, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    if len(domain_rules) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    tokens = {t for p in patterns for t in parse_pattern(p).tokens}
    shared = pages.sparkSession.sparkContext.broadcast((domain_rules, patterns, token_counts(rows, tokens)))
    return rows.mapInArrow(_judge(shared), "page_id long, host string, path string, rule string, verdict string")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, domain rule and verdict of every page's URL."""
    return filter_urls(small_batches(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    asc = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parsed = [parse_pattern(p) for p in PATTERNS]
    hit = lambda allow: " or ".join(f"regexp_matches(low, '{p.regex}', 's')" for p in parsed if p.allow == allow) or "false"
    case = lambda what: "case " + " ".join(
        f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '/{p}') then '{v if what else r}'"
        for v, r, h, p in sorted(((v, r, *r.split("/", 1)) for v, r in DOMAIN_RULES), key=lambda x: -len(x[1]))
    ) + " end"
    return f"""
with a as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as after, {asc("coalesce(url, '')")} as low from pages
), b as (
  select page_id, low, {asc("regexp_extract(after, '^([^/?#]*)', 1)")} as host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) as path from a
)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, {case(False)} as rule,
  coalesce({case(True)}, case when {hit(True)} then 'allow' when {hit(False)} then 'block' else 'allow' end) as verdict
from b
"""


ORACLE_SQL = _sql()
