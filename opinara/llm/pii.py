"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  Wider patterns
propose more spans; a strict form, a gazetteer, the words before a span and its shape vote on
each, and EM over the counted vote patterns finds how far each labeler can be trusted.  The
resulting probabilities train a logistic span classifier on plain span features; candidates
that it accepts and that touch no base span are added.  Everything on rows is a Spark
expression; the driver only sees one row per pattern of votes and features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_text

# --- fixed values: kinds in order, and the patterns of the base spans ------------------------
# As specified, with possessive loops and starts bound to the start of a run (or the end of the
# match before), which find the same spans without backtracking over long runs.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9]){13,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}

# --- the wider patterns, gazetteers and context words (our own choice) -------------------------
WIDER = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\\x20?(?:@|\\((?:at|AT)\\)|\\[(?:at|AT)\\])\\x20?"
             "[A-Za-z0-9-]++(?:(?:\\.|\\x20?\\((?:dot|DOT)\\)\\x20?|\\x20?\\[(?:dot|DOT)\\]\\x20?)[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": "(?<![0-9A-Za-z.+-])[0-9]{4}[\\x20.-][0-9]{4}[\\x20.-][0-9]{4}[\\x20.-][0-9]{2,4}(?![0-9A-Za-z])",
    "phone": "(?<![0-9A-Za-z.+-])(?:\\([0-9]{2,4}\\)\\x20?|[0-9]{2,4}[\\x20./-])[0-9]{3,4}[\\x20.-][0-9]{3,4}(?![0-9A-Za-z.-])",
}
GAZETTEER = {
    "email": "(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|eu)$",
    "ip": "^(?:2[0-9a-fA-F]{3}|f[cde][0-9a-fA-F]{2}|(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\\.)",
    "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": "^\\+?\\(?(?:1|20|3[0-9]|4[0-9]|5[0-8]|6[0-6]|7|8[1246]|9[0-58]|0)",
}
CONTEXT = {
    "email": "(?i)(?:mail|contact|write|reach|adresse|correo|schreib)[^\\n]{0,20}$",
    "ip": "(?i)(?:\\bip\\b|addr|host|server|login|client)[^\\n]{0,20}$",
    "card": "(?i)(?:card|visa|credit|karte|carte|tarjeta|konto|account)[^\\n]{0,20}$",
    "phone": "(?i)(?:phone|tel|call|fax|mobil|handy|numero|nummer|contact)[^\\n]{0,20}$",
}
#: A span inside a token, a quotation or an assignment is rather a key or a measure.
AGAINST = "(?:[=\"'#$/_:A-Za-z0-9-]|\\b(?:token|key|id|sha|hash|version|no)\\.?\\s?)$"
SHAPE = {
    "email": "^[^@\\s]{1,64}\\s?(?:@|[\\[(]).{3,}$",
    "ip": "^(?:(?:0|[1-9][0-9]{0,2})(?:\\.(?:0|[1-9][0-9]{0,2})){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})$",
    "card": "^(?:[0-9]{4}([\\x20-]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{2,7}|[0-9]{14,19})$",
    "phone": "^\\+?[0-9]{0,3}[\\x20.-]?(?:\\([0-9]{2,4}\\)|[0-9]{2,4})(?:[\\x20./-]?[0-9]{3,4}){2,3}$",
}
LABELERS = ("strict", "gazetteer", "context", "shape")
#: Accepted from this probability on.
ACCEPTED = 0.9

SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """The tests that a match of the base pattern must pass."""
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: F.coalesce(
            F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    if kind == "card":
        n = F.length(_digits(value))
        return n.between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


#: Elements that a scan appends to one array before it opens the next.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, state: Column, step) -> Column:
    """What ``step(state, item)`` puts out, an array as long as ``items``; it returns the next state and the output.

    An appended array is copied, so outputs are gathered in blocks: a text with many spans costs blocks squared,
    not spans squared.
    """
    def over(items: Column) -> Column:
        nothing = F.transform(F.slice(items, 1, 0), lambda i: step(state, i)[1])

        def inner(acc: Column, i: Column) -> Column:
            after, out = step(acc["state"], i)
            return F.struct(after.alias("state"), F.array_append(acc["out"], out).alias("out"))

        def block(acc: Column, n: Column) -> Column:
            begin = F.struct(F.element_at(acc, -1)["state"].alias("state"), nothing.alias("out"))
            return F.array_append(acc, F.aggregate(F.slice(items, n * BLOCK + 1, F.lit(BLOCK)), begin, inner))
        blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
        done = F.aggregate(blocks, F.array(F.struct(state.alias("state"), nothing.alias("out"))), block)
        return F.when(F.size(items) == 0, nothing).otherwise(F.flatten(F.transform(done, lambda d: d["out"])))
    return _let(items, over)


def _spans(text: Column, pattern: str, test, gate: Column) -> Column:
    """Matches of ``pattern`` that pass ``test``, with code point offsets and up to 40 characters around.

    The text between matches comes from splitting by the same pattern; offsets are running sums.
    """
    def between(found: Column, gaps: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return F.zip_with(pairs, F.slice(gaps, 2, F.size(found)), lambda p, g: F.struct(
            p["gap"].alias("gap"), p["match"].alias("match"), F.left(g, F.lit(40)).alias("after")))

    def step(at: Column, p: Column):
        begin = at + F.length(p["gap"])
        end = begin + F.length(p["match"])
        return end, F.struct(begin.alias("start"), end.alias("end"), p["match"].alias("value"),
                             F.right(p["gap"], F.lit(40)).alias("before"), p["after"].alias("after"))
    pairs = _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")),
                 lambda t: between(t["found"], t["gaps"]))
    return F.when(gate, F.filter(_scan(pairs, F.lit(0), step), lambda s: test(s["value"]))).otherwise(F.array().cast(SPAN))


def _gate(kind: str, text: Column, wide: bool) -> Column:
    """A cheap test that spares most texts the full pattern."""
    if kind == "email":
        return text.contains("@") | (text.rlike("[(\\[](?:at|AT)[)\\]]") if wide else F.lit(False))
    if kind == "phone" and not wide:
        return text.contains("+")
    return text.rlike(WIDER[kind] if wide else BASE[kind])


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the base spans of a text without null."""
    return {k: _spans(text, BASE[k], lambda m, k=k: _valid(k, m), _gate(k, text, False)) for k in KINDS}


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, s: Column) -> Column:
    value, before = s["value"], s["before"]
    strict = value.rlike(f"^(?:{BASE[kind]})$") & _valid(kind, value)
    listed = (_digits(value) if kind == "card" else value).rlike(GAZETTEER[kind])
    # the strict form says yes or nothing: what it misses are the very spans that the others are asked about
    return F.struct(_vote(strict, F.lit(False)).alias("strict"), _vote(listed, ~listed).alias("gazetteer"),
                    _vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)).alias("context"),
                    _vote(value.rlike(SHAPE[kind]), ~value.rlike(SHAPE[kind])).alias("shape"))


#: Features of the span classifier, each 0 or 1.
def _features(kind: str, s: Column) -> list[Column]:
    value = s["value"]
    digits = F.length(_digits(value))
    return [F.lit(kind == k) for k in KINDS] + [
        value.contains("("), value.contains("@"), value.contains("."), value.contains(" "), value.contains("+"),
        digits.between(9, 15), digits > 15, s["before"].rlike("[A-Za-z0-9\"'=/#_-]$"), s["after"].rlike("^[A-Za-z0-9\"'=/#_-]"),
        s["before"].rlike("(?:^|\\s)$") & s["after"].rlike("^(?:[\\s.,;:!?)]|$)")]


FEATURES = len(KINDS) + 10


def _candidates(text: Column) -> dict[str, Column]:
    return {k: _spans(text, WIDER[k], lambda m: F.lit(True), _gate(k, text, True)) for k in KINDS}


def _bits(features: list[Column]) -> Column:
    total = F.lit(0)
    for i, f in enumerate(features):
        total = total + F.coalesce(f, F.lit(False)).cast("int") * (1 << i)
    return total


@dataclass(frozen=True)
class Model:
    """Labeler reliabilities ``P(vote | real)`` and ``P(vote | not)``, and the classifier's weights (last: constant)."""
    reliability: dict[str, dict[int, tuple[float, float]]]
    prior: float
    weights: tuple[float, ...]


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, known: frozenset = frozenset()):
    """Prior, reliabilities and posteriors of vote patterns with counts; starts from the share of yes votes.

    Patterns in ``known`` are personal data for certain and keep the posterior 1.
    """
    post = [1.0 if votes in known else (sum(v > 0 for v in votes) + 0.5) / (sum(v != 0 for v in votes) + 1) for votes, _ in patterns]
    total = sum(n for _, n in patterns)
    prior, tables = 0.5, []
    for _ in range(rounds):
        real = sum(p * n for p, (_, n) in zip(post, patterns))
        prior = (real + 1) / (total + 2)
        tables = []
        for k in range(len(patterns[0][0])):
            table = {}
            for vote in (-1, 0, 1):
                yes = sum(p * n for p, (v, n) in zip(post, patterns) if v[k] == vote)
                no = sum((1 - p) * n for p, (v, n) in zip(post, patterns) if v[k] == vote)
                table[vote] = ((yes + 0.1) / (real + 0.3), (no + 0.1) / (total - real + 0.3))
            tables.append(table)
        post = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes) if v)
            post.append(1.0 if votes in known else 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return prior, tables, post


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    n = len(right)
    rows = [row[:] + [r] for row, r in zip(matrix, right)]
    for i in range(n):
        pivot = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for r in range(n):
            if r != i and rows[r][i]:
                factor = rows[r][i] / rows[i][i]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[i])]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def logistic(rows: list[tuple[list[float], float, float]], ridge: float = 1.0, rounds: int = 12) -> list[float]:
    """Weights that fit soft targets: ``(features, target, count)`` rows, by Newton steps."""
    d = len(rows[0][0]) + 1
    w = [0.0] * d
    for _ in range(rounds):
        gradient = [-ridge * x for x in w]
        hessian = [[ridge * (i == j) for j in range(d)] for i in range(d)]
        for features, target, n in rows:
            x = [i for i, f in enumerate(features) if f] + [d - 1]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in x)))))
            for i in x:
                gradient[i] += n * (target - p)
                for j in x:
                    hessian[i][j] += n * p * (1 - p)
        w = [a + b for a, b in zip(w, _solve(hessian, gradient))]
    return w


def fit(docs: DataFrame) -> Model | None:
    """Learn from the candidates and base spans of all texts; None if there are none."""
    text = F.coalesce("text", F.lit(""))
    base, wider = base_spans(text), _candidates(text)

    def described(kind: str) -> Column:
        return F.transform(F.concat(base[kind], wider[kind]), lambda s: F.struct(
            _votes(kind, s).alias("votes"), _bits(_features(kind, s)).alias("bits")))
    counted = (docs.select(F.explode(F.concat(*map(described, KINDS))).alias("s")).groupBy("s.votes", "s.bits").count()
               .orderBy("votes", "bits").collect())
    if not counted:
        return None
    votes: dict[tuple[int, ...], int] = {}
    for r in counted:
        key = tuple(r["votes"])
        votes[key] = votes.get(key, 0) + r["count"]
    patterns = sorted(votes.items())
    prior, tables, post = expectation_maximisation(patterns, known=frozenset(v for v, _ in patterns if v[0] > 0))
    belief = dict(zip((v for v, _ in patterns), post))
    rows = [([float(r["bits"] >> i & 1) for i in range(FEATURES)], belief[tuple(r["votes"])], float(r["count"])) for r in counted]
    return Model(dict(zip(LABELERS, tables)), prior, tuple(round(w, 12) for w in logistic(rows)))


def _accepted(model: Model, kind: str, s: Column) -> Column:
    linear = F.lit(model.weights[-1])
    for w, f in zip(model.weights, _features(kind, s)):
        linear = linear + F.when(F.coalesce(f, F.lit(False)), w).otherwise(0.0)
    return linear >= math.log(ACCEPTED / (1 - ACCEPTED))


def _named(kind: str, spans: Column) -> Column:
    order = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
                                                 F.lit(kind).alias("kind")))


def find(docs: DataFrame, model: Model | None, base_as: str = "base_spans", spans_as: str = "spans") -> DataFrame:
    """All columns of ``docs`` and ``base_spans``, ``spans``: sorted arrays of (start, order, end, kind).

    Offsets are code points of the whole text, ends exclusive; a null text has no spans.
    Added spans touch no base span nor an added one before them.  Columns of the two names are replaced.
    """
    docs = docs.drop(base_as, spans_as)
    text = F.coalesce("text", F.lit(""))
    base = base_spans(text)
    found = docs.withColumn(base_as, F.array_sort(F.concat(*(_named(k, base[k]) for k in KINDS))))
    if model is None:
        return found.withColumn(spans_as, F.col(base_as))
    wider = _candidates(text)

    def accepted(kind: str) -> Column:
        return _named(kind, F.filter(wider[kind], lambda s: _accepted(model, kind, s)))
    proposed = F.concat(*map(accepted, KINDS))
    return found.withColumn(spans_as, _let(proposed, lambda p: F.when(F.size(p) == 0, F.col(base_as)).otherwise(
        _with_added(F.col(base_as), p))))


def _with_added(base: Column, proposed: Column) -> Column:
    """Base spans and those proposed ones that touch none of them nor an added one before, sorted.

    Two scans of the sorted spans: from the end, the start of the next base span; from the front, how far base and
    added spans reach.
    """
    def tagged(spans: Column, added: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"], F.lit(added).alias("added")))

    def backward(upcoming: Column, s: Column):
        return (F.when(s["added"], upcoming).otherwise(s["start"]),
                F.struct(s.alias("span"), upcoming.alias("upcoming")))

    def forward(reach: Column, e: Column):
        s = e["span"]
        stays = ~s["added"] | ((reach <= s["start"]) & (s["end"] <= e["upcoming"]))
        return (F.when(stays, F.greatest(reach, s["end"])).otherwise(reach),
                F.struct(s["start"], s["order"], s["end"], s["kind"], stays.alias("stays")))
    merged = F.array_sort(F.concat(tagged(base, False), tagged(proposed, True)))
    ahead = F.reverse(_scan(F.reverse(merged), F.lit(2**31 - 1), backward))
    return F.transform(F.filter(_scan(ahead, F.lit(0), forward), lambda s: s["stays"]), lambda s: F.struct(
        s["start"], s["order"], s["end"], s["kind"]))


def joined(spans: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars``, if there is one, is set anew.

    Of overlapping spans (an address inside a phone number) the first is replaced and the rest
    of a later one is cut with it.  Null texts stay null; other columns are returned as they came.
    """
    found = find(docs, fit(docs), "__base", "__spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))
    text = F.when(F.size("__spans") == 0, F.col("text")).otherwise(F.aggregate(
        "__spans", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1))))
    return with_text(found.withColumn("__text", text), "__text", docs)
