"""PII by candidate gradient boosting, in DataFrame functions alone.

Base spans come from fixed patterns and are always kept.  High-recall generators propose further spans (addresses with
"(at)" and "dot", telephone numbers without a plus, card numbers of 13 to 15 digits), which may overlap; boosted trees over
features of the format and of the words around score them; scores are calibrated per kind on one held-out part of a written
training table, and a threshold, set where candidates of another part reach the wanted precision, selects.  The trees are fitted on the driver from that table and become SQL
expressions, so the main path runs no Python.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, table

LOCAL = "[A-Za-z0-9._%+-]"
HOST = "[A-Za-z0-9-]"
#: Possessive repeats, and starts only where a run of the leading class starts, find what the plain patterns find in time
#: linear in the text: all starts inside such a run lead to the same continuation.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.|$)){4}$"

#: Generators: kind, cheap test that holds wherever the pattern is found, pattern.
GENERATORS = {
    "email": (
        r"(?i)[(\[{]at[)\]}]|\x20at\x20",
        rf"(?i)(?<!{LOCAL}){LOCAL}{{1,64}}+(?:\x20?[(\[{{]at[)\]}}]\x20?|\x20at\x20){HOST}{{1,63}}+(?:(?:\x20?[(\[{{]dot[)\]}}]\x20?|\x20dot\x20|\.){HOST}{{1,63}}+){{1,4}}+",
    ),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])"),
    "phone": (r"[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])"),
}
#: Features: name, field, pattern; each is 1 where the pattern is found in the field.
FEATURES = (
    ("asks_phone", "before", r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp|contact)\W{0,3}(?:\w{1,8}\W{1,3})?$"),
    ("asks_card", "before", r"(?i)(?:card|visa|amex|mastercard|payment|credit|debit)\W{0,3}(?:\w{1,8}\W{1,3})?$"),
    ("asks_email", "before", r"(?i)(?:mail|contact|write|reach|address)\W{0,3}(?:\w{1,8}\W{1,3})?$"),
    ("asks_other", "before", r"(?i)(?:isbn|issn|order|invoice|ref|version|serial|sku|part|id|no|nr|build|page|section|doi)\W{0,3}$"),
    ("glued_before", "before", r"[A-Za-z0-9_#/=:$%@&*-]$"),
    ("glued_after", "after", r"^[A-Za-z0-9_/=@%*-]"),
    ("parens", "value", r"^\([0-9]{3}\)"),
    ("hyphens", "value", r"[0-9]-[0-9]"),
    ("dots", "value", r"[0-9]\.[0-9]"),
    ("bracketed", "value", r"(?i)[(\[{]at[)\]}]"),
    ("spelled", "value", r"(?i)\bdot\b"),
    ("odd_area", "value", r"^\(?[01]"),
    ("issuer", "value", r"^(?:3[47]|3[0689]|6[0-9]|5[0-9]|4)"),
    ("tld", "value", r"(?i)(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk)$"),
)
KINDS = ("email", "ip", "card", "phone")
#: Matches whose places are summed up together; and so many proposed spans, in the order of starts, can overlap one at most: a
#: span has 420 characters at most (64 + 6 + 63 + 4 * 70), and those of a kind, of 8 at least, lie apart.
STRIDE, NEAR = 64, 330
_SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"


# ---- spans ----------------------------------------------------------------------------------------------------------
def _spans(text: Column, kind: str, pattern: str, context: int = 0) -> Column:
    """Leftmost non-overlapping matches as (kind, start, end, value, before, after), offsets in code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    packed = F.struct(hits.alias("hits"), gaps.alias("gaps"), F.transform(hits, F.length).alias("long"), F.transform(gaps, F.length).alias("wide"))

    def from_packed(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["pos"] + F.element_at(p["wide"], i)
            end = start + F.element_at(p["long"], i)
            before = F.right(F.element_at(p["gaps"], i), F.lit(context)) if context else F.lit("")
            after = F.left(F.element_at(p["gaps"], i + 1), F.lit(context)) if context else F.lit("")
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.element_at(p["hits"], i).alias("value"), before.alias("before"), after.alias("after"))
            return F.struct(end.alias("pos"), F.array_append(acc["out"], span).alias("out"))

        def moved(block: Column, by: Column) -> Column:
            return F.transform(block["out"], lambda s: F.struct(
                s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")
            ))

        # places inside blocks first, then those of the blocks, so that growing an array costs little however many spans there are
        n, none = F.size(p["hits"]), F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))
        blocks = F.transform(F.sequence(F.lit(1), n, F.lit(STRIDE)), lambda lo: F.aggregate(F.sequence(lo, F.least(lo + STRIDE - 1, n)), none, step))
        begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("at"))
        places = lambda bs: F.aggregate(bs, begin, lambda acc, k: F.struct((acc["pos"] + k["pos"]).alias("pos"), F.array_append(acc["at"], acc["pos"]).alias("at")), lambda acc: acc["at"])
        whole = F.transform(F.array(blocks), lambda bs: F.flatten(F.zip_with(bs, places(bs), moved)))[0]
        return F.when(n > 0, whole).otherwise(F.array().cast(_SPAN))

    return F.transform(F.array(packed), from_packed)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns that pass their checks, by kind and start."""
    none = F.array().cast(_SPAN)
    between = lambda v, lo, hi: F.length(_digits(v)).between(lo, hi)
    return F.concat(
        F.when(F.contains(text, F.lit("@")), _spans(text, "email", EMAIL)).otherwise(none),
        F.when(text.rlike(IP), F.filter(_spans(text, "ip", IP), lambda s: s["value"].rlike(IP_PARTS))).otherwise(none),
        F.when(text.rlike(CARD), F.filter(_spans(text, "card", CARD), lambda s: F.when(between(s["value"], 16, 19), luhn(_digits(s["value"]))).otherwise(False))).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(_spans(text, "phone", PHONE), lambda s: between(s["value"], 8, 15))).otherwise(none),
    )


def candidates(text: Column) -> Column:
    none = F.array().cast(_SPAN)
    return F.concat(*(F.when(text.rlike(test), _spans(text, kind, pattern, 24)).otherwise(none) for kind, (test, pattern) in GENERATORS.items()))


# ---- the trees ------------------------------------------------------------------------------------------------------
def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def training_table(rows: int = 4000, seed: int = 3) -> list[tuple[str, str, str, str, int]]:
    """(kind, before, value, after, label): personal data and look-alikes, as people write them."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    out = []
    for _ in range(rows):
        kind, good = rng.choice(tuple(GENERATORS)), rng.random() < 0.5
        before, after = f"{word()} {word()} ", rng.choice((" ", ". ", ", ")) + word()
        if kind == "phone":
            a, b, c = rng.choice("23456789") + d(2), d(3), d(4)
            value = rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"))
            if good:
                before += rng.choice(("call ", "tel: ", "phone ", "fax: ", "mobile ", "call us ", "contact "))
            else:
                before += rng.choice(("", "order ", "ref ", "part no. ", "id=", "#", "ISBN "))
                value = rng.choice((f"{d(3)} {b} {c}", f"{d(3)}.{b}.{c}", f"{d(3)}-{b}-{c}"))
        elif kind == "card":
            digits = rng.choice(("34", "37", "36", "30")) + d(12)
            if good:
                digits += next(x for x in "0123456789" if _luhn(digits + x))
                before += rng.choice(("card ", "amex ", "credit card: ", "card number ", "payment "))
            else:
                digits = d(rng.randint(13, 15))
                before += rng.choice(("", "", "ISBN ", "id: ", "order ", "serial ", "card "))
            value = rng.choice((digits, f"{digits[:4]} {digits[4:10]} {digits[10:]}"))
        else:
            host = f"{word()}{rng.choice((' dot ', ' (dot) ', '[dot]', '.', '.'))}{rng.choice(('com', 'org', 'net', 'de'))}"
            asks = rng.choice(("mail ", "contact ", "write to ", "reach ", "e-mail: "))
            if good:
                value = f"{word()}{rng.choice((' (at) ', '[at]', '(at)', ' at ', ' at '))}{host}"
                if " at " not in value or "dot" in value:
                    asks = rng.choice((asks, ""))  # spelled out, it speaks for itself
                before += asks
            elif rng.random() < 0.3:
                value = f"{word()} at {host.replace('[dot]', '.').replace(' (dot) ', '.').replace(' dot ', '.')}"  # a shop, not a mailbox
            else:
                before += rng.choice(("", "", asks))
                value = f"{word()} at {word()}{rng.choice(('.', ' dot '))}{word()}"
        out.append((kind, before[-24:], value, after[:24], int(good)))
    return out


def _row(kind: str, before: str, value: str, after: str) -> list[int]:
    fields = {"before": before, "value": value, "after": after}
    digits = re.sub("[^0-9]", "", value)
    return [int(bool(re.search(p, fields[f]))) for _, f, p in FEATURES] + [int(bool(digits) and _luhn(digits))] + [int(kind == k) for k in GENERATORS]


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree over 0/1 features: (feature, tree at 0, tree at 1) or a leaf's step."""
    step = float(round(-g.sum() / (h.sum() + 1.0), 6))
    if not depth:
        return step
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    best, at = 1e-6 + gain(slice(None)), None
    for f in range(x.shape[1]):
        on = x[:, f] == 1
        if 5 <= on.sum() <= len(on) - 5 and (v := gain(on) + gain(~on)) > best + 1e-9:
            best, at = v, f
    if at is None:
        return step
    on = x[:, at] == 1
    return at, _tree(x[~on], g[~on], h[~on], depth - 1), _tree(x[on], g[on], h[on], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, off, on = tree
    return np.where(x[:, f] == 1, _value(on, x), _value(off, x))


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) with which 1 / (1 + exp(-(a * raw + b))) is the likeliest share of ones, by Newton's method."""
    x, ab = np.stack([raw, np.ones(len(raw))], 1), np.array([1.0, 0.0])
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        ab = ab - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - soft))
    return float(round(ab[0], 6)), float(round(ab[1], 6))


@lru_cache(1)
def model(rounds: int = 40, depth: int = 3, rate: float = 0.3, precision: float = 0.98):
    """(trees, rate, calibration of each kind, threshold of each kind): trees are fitted on half of the table, scores
    calibrated on a quarter and thresholds set on the rest."""
    rows = training_table()
    x, y = np.array([_row(*r[:4]) for r in rows]), np.array([r[4] for r in rows])
    turn = np.arange(len(rows)) % 4
    fit = turn < 2
    raw, trees = np.zeros(len(rows)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        trees.append(_tree(x[fit], (p - y)[fit], (p * (1 - p))[fit], depth))
        raw += rate * _value(trees[-1], x)
    scales, bounds = {}, {}
    for kind in GENERATORS:
        mine = np.array([r[0] == kind for r in rows])
        a, b = scales[kind] = platt(raw[mine & (turn == 2)], y[mine & (turn == 2)])
        p = 1 / (1 + np.exp(-(a * raw + b)))
        last = mine & (turn == 3)
        # the least score from which on the wanted share is right; a kind without one adds nothing
        good = [t for t in np.unique(p[last]) if t >= 0.5 and y[last & (p >= t)].mean() >= precision]
        bounds[kind] = float(min(good, default=1.1)) - 1e-9
    return trees, rate, scales, bounds


def _score(span: Column) -> Column:
    """The calibrated score, features worked out once a span."""
    digits = _digits(span["value"])
    flags = [span[f].rlike(p) for _, f, p in FEATURES] + [F.when(F.length(digits) > 0, luhn(digits)).otherwise(False)] + [span["kind"] == k for k in GENERATORS]
    trees, rate, scales, _ = model()
    of_kind = lambda i: F.element_at(F.create_map(*(F.lit(v) for k, ab in scales.items() for v in (k, ab[i]))), span["kind"])

    def total(flags_: Column) -> Column:
        def walk(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, off, on = tree
            return F.when(F.element_at(flags_, f + 1), walk(on)).otherwise(walk(off))

        raw = F.lit(0.0)
        for t in trees:
            raw = raw + walk(t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(of_kind(0) * F.lit(rate) * raw + of_kind(1))))

    return F.transform(F.array(F.array(*flags)), total)[0]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, spans) of every row of docs(doc_id, text, ...): base spans, and all spans, as arrays.

    Spans are structs (kind, start, end, ...) in code points, end exclusive, by kind in the order email, ip, card, phone and
    then by start.  Null texts count as empty and have no spans; repeated rows give a row each; null ids stay; other columns
    are ignored; an empty table gives no rows.
    """
    *_, bounds = model()
    rows = docs.select("doc_id", body().alias("text"))
    rows = rows.select("*", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("maybe"))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    scored = F.transform(F.filter("maybe", apart), lambda s: F.struct(_score(s).alias("score"), s.alias("span")))
    chosen = F.filter(scored, lambda c: c["score"] >= F.element_at(F.create_map(*(F.lit(x) for kb in bounds.items() for x in kb)), c["span"]["kind"]))
    rows = rows.select("doc_id", "text", "base", F.when(F.size("maybe") > 0, chosen).otherwise(F.array()).alias("chosen"))
    # in the order of starts, what overlaps a span lies within NEAR places of it
    rows = rows.withColumn("chosen", F.array_sort("chosen", lambda a, b: a["span"]["start"] - b["span"]["start"]))
    beaten = lambda c, i: F.exists(
        F.slice("chosen", F.greatest(i + 1 - NEAR, F.lit(1)), F.lit(2 * NEAR)), lambda o: (o["span"]["start"] < c["span"]["end"]) & (c["span"]["start"] < o["span"]["end"])
        & ((o["score"] > c["score"]) | ((o["score"] == c["score"]) & (o["span"]["kind"] < c["span"]["kind"])))
    )
    added = F.transform(F.filter("chosen", lambda c, i: ~beaten(c, i)), lambda c: c["span"])
    of_kind = lambda k: F.filter(F.concat("base", added), lambda s: s["kind"] == k)
    ordered = F.concat(*(F.array_sort(of_kind(k), lambda a, b: a["start"] - b["start"]) for k in KINDS))
    return rows.select("doc_id", "text", "base", F.when(F.size("chosen") > 0, ordered).otherwise(F.col("base")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        gap = F.substring(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(fresh, F.array_append(acc["out"], F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))).otherwise(acc["out"]).alias("out"),
        )

    first = lambda pos: F.struct(pos.alias("pos"), F.array().cast("array<string>").alias("out"))

    def block(acc: Column, lo: Column) -> Column:
        # spans are taken in blocks, which are joined, so that growing an array costs little however many spans there are
        done = F.aggregate(F.slice(ordered, lo, F.lit(STRIDE)), first(acc["pos"]), step)
        return F.transform(F.array(done), lambda d: F.struct(d["pos"].alias("pos"), F.array_append(acc["out"], F.array_join(d["out"], "")).alias("out")))[0]

    whole = F.aggregate(
        F.sequence(F.lit(1), F.size(spans), F.lit(STRIDE)), first(F.lit(0)), block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of its text redacted, all columns kept, and n_chars, where there is one, made the new length.

    Null texts stay null, and rows without spans are as they were.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), "text")
    found = find(packed).select(F.col("doc_id").alias("row"), F.size("spans").alias("n"), redacted(F.col("text"), F.col("spans")).alias("new"))
    own = lambda c: F.col("row")[c]
    changed = {"text": F.col("new"), "n_chars": F.length("new").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*(F.when(F.col("n") > 0, changed[c]).otherwise(own(c)).alias(c) if c in changed else own(c).alias(c) for c in docs.columns))
