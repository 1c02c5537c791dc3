"""URL filters: pattern rules fetched by their rarest literal token.

Every rule is a regular expression over host and path with the literal tokens that a fitting
URL must contain.  It is filed under the one that is rarest in the URLs at hand; a URL's own
tokens fetch the rules to try, and only those regular expressions run.  A fitting rule of
highest rank decides (host rules: the longest; pattern rules come after all of them).
Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the index is a literal in the plan; more rules are joined by token.
INLINE_RULES = 500
TOKENS = "[^A-Za-z0-9]+"
RANK_OF_HOSTS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host + path; ``tokens`` are whole tokens of any text that it fits."""
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int
    shown: bool = True


def host_rule(verdict: str, name: str) -> Rule:
    """A rule like ``example.com/en/``: the host or a subdomain, and a path that starts with the rule's."""
    host, slash, path = name.partition("/")
    path = slash + path
    whole = path if path.endswith("/") else path[:max(path.rfind("/"), 0)]  # the rest may be part of a token
    tokens = [t for t in re.split(TOKENS, f"{host}/{whole}") if t]
    escaped = re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + path)
    return Rule(name, f"^(?:[^/]*\\.)?{escaped}", tuple(tokens), verdict, RANK_OF_HOSTS + len(name))


def word_rule(verdict: str, *words: str) -> Rule:
    """Fits a URL whose host or path has the words one after another, divided by one sign."""
    pattern = "(?:^|[^A-Za-z0-9])" + "[^A-Za-z0-9]".join(words) + "(?:[^A-Za-z0-9]|$)"
    return Rule("-".join(words), pattern, words, verdict, len(words), shown=False)


#: Words of unwanted sites, the default of the pattern rules (fixed values of our own).
UNWANTED = (("casino", "win"), ("casino",), ("poker",), ("jackpot",), ("viagra",), ("porn",), ("xxx",), ("adult", "chat"),
            ("free", "download", "crack"), ("payday", "loan"), ("replica", "watches"), ("cheap", "pills"))
PATTERN_RULES = tuple(word_rule("block", *w) for w in UNWANTED)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.split(subject, TOKENS))


def rarest_tokens(subjects: DataFrame, rules: list[Rule]) -> dict[Rule, str | None]:
    """The token that each rule is filed under; ``None``: it has no literal and is always tried."""
    literals = sorted({t for r in rules for t in r.tokens})
    counts = dict.fromkeys(literals, 0)
    if literals:
        known = F.array(*map(F.lit, literals)) if len(literals) <= INLINE_RULES else None
        tokens = _tokens(F.col("subject"))
        if known is not None:
            found = subjects.select(F.explode(F.array_intersect(tokens, known)).alias("token"))
        else:
            listed = subjects.sparkSession.createDataFrame([(t,) for t in literals], "token string")
            found = subjects.select(F.explode(tokens).alias("token")).join(listed, "token")
        counts |= {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}
    return {r: min(r.tokens, key=lambda t: (counts[t], t)) if r.tokens else None for r in rules}


def _struct(rule: Rule) -> Column:
    return F.struct(F.lit(rule.rank).alias("rank"), F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"),
                    F.lit(rule.shown).alias("shown"), F.lit(rule.pattern).alias("pattern"))


ENTRY = "rank int, name string, verdict string, shown boolean, pattern string"


def _best(candidates: Column) -> Column:
    """The fitting candidate of highest rank; block before allow on equal rank."""
    fitting = F.filter(candidates, lambda r: F.regexp_like(F.col("subject"), r["pattern"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["rank"], r["verdict"], r["name"], r["shown"])))


def judge(urls: DataFrame, rules: list[Rule], default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """All columns of ``urls(url, ..)`` and ``host``, ``path``, ``rule``, ``verdict``.

    ``rule`` names the deciding host rule, null if none fits; then a pattern rule or ``default``
    gives the verdict.  A null URL or one without ``://`` has empty host and path.  Columns of
    those four names in ``urls`` are replaced; repeated rows are judged alike.
    """
    urls = urls.drop("host", "path", "rule", "verdict")
    columns = urls.columns
    parted = (urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
              .withColumn("subject", F.concat("host", "path")))
    filed = rarest_tokens(parted.select("subject"), rules)
    always = [_struct(r) for r, t in filed.items() if t is None]
    empty = F.array().cast(f"array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>")
    rest = F.array(*always) if always else empty
    by_token: dict[str, list[Rule]] = {}
    for rule, token in filed.items():
        if token is not None:
            by_token.setdefault(token, []).append(rule)
    if len(rules) <= inline:
        index = (F.create_map(*[x for t, rs in sorted(by_token.items()) for x in (F.lit(t), F.array(*map(_struct, rs)))])
                 if by_token else None)
        fetched = (F.flatten(F.filter(F.transform(_tokens(F.col("subject")), lambda t: F.element_at(index, t)),
                                      lambda r: r.isNotNull())) if index is not None else empty)
        found = parted.withColumn("best", _best(F.concat(fetched, rest)))
    else:
        listed = parted.sparkSession.createDataFrame(
            [(t, r.rank, r.name, r.verdict, r.shown, r.pattern) for t, rs in by_token.items() for r in rs], f"token string, {ENTRY}")
        once = parted.select("subject").distinct()
        fits = (once.withColumn("token", F.explode(_tokens(F.col("subject")))).join(listed, "token")
                .where("regexp_like(subject, pattern)")
                .groupBy("subject").agg(F.max(F.struct("rank", "verdict", "name", "shown")).alias("top")))
        found = (parted.join(fits, "subject", "left")
                 .withColumn("best", F.greatest("top", _best(rest)) if always else F.col("top")))
    return found.select(*columns, "host", "path", F.when(F.col("best.shown"), F.col("best.name")).alias("rule"),
                        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
