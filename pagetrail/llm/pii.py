"""Personal data: candidates by high-recall generators, boosted trees over format and context, calibrated thresholds.

Base rules with fixed patterns always hold. Beyond them generators propose overlapping spans: groups of digits in every window of a
chain of numbers, names and hosts with an at sign or a word for it, addresses with their dots written out. Trees score each proposal by
its form and by what stands around it; those above their kind's threshold that meet no base span are added, best first.

There are no labels. Positives are base spans in their place, and the same written in ways that no base rule takes (without a plus,
spaced, with words for signs). Negatives are parts of those, base matches that fail their check and altered digits. Proposals that meet
none of these are free: the trees take them for negatives, but as the text may hold what no base rule takes, a few may score high.
The fit, counts, proposals and decisions cover every whole text of every row.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_row, small_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Examples that a task holds before it passes them on.
HELD = 2000
#: Decimals of a margin of the trees, so that the driver gets a row for each kind and level: some 15,000 levels at most.
LEVELS = 3
#: Share of right ones among the held-out examples at or above a kind's threshold; free ones there at most, for each right one; and
#: examples of a class without which nothing is fitted.
PRECISION = 0.995
FREE = 0.1
LEAST = 20
#: Characters around a span that count as its context.
AROUND = 40
#: Groups of digits that a proposal takes at most.
GROUPS = 8

Span = tuple[str, int, int]

_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(x) - 9 * (x > "4") for x in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, behind = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > behind and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _HOST.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            behind = m.end()
        at = text.find("@", max(at + 1, behind))


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, lo = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            hi = lo + sum(map(len, four)) + 3
            yield lo, hi, all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four)
            lo = hi + 1


def matches(text: str) -> tuple[list[Span], list[Span]]:
    """The base rules' leftmost matches that pass their check, by start and then kind, and those that are no more than their kind can
    be and fail it. Linear in the text."""
    out: list[tuple[int, int, int]] = []
    failed: list[Span] = []
    out += [(lo, 0, hi) for lo, hi in _emails(text)]
    for lo, hi, holds in _ips(text):
        out.append((lo, 1, hi)) if holds else failed.append(("ip", lo, hi))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19:
            out.append((m.start(), 2, m.end())) if luhn(digits) else failed.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        n = len(_NOT_DIGITS.sub("", m[0]))
        if n <= 15:
            out.append((m.start(), 3, m.end())) if n >= 10 else failed.append(("phone", m.start(), m.end()))
    return [(KINDS[k], lo, hi) for lo, k, hi in sorted(out)], failed


def base_spans(text: str) -> list[Span]:
    return matches(text)[0]


_CHAIN = re.compile(r"[0-9](?:[ ().\-/]{0,3}[0-9])*")
_AT = re.compile(r"@|[\[({<]\s?(?:at|AT)\s?[\])}>]|\s(?:at|AT)\s")
_RIGHT = re.compile(r"\s?[\w-]{1,63}(?:(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)[\w-]{1,63}){1,4}")
_LEFT = re.compile(r"[\w.%+-]{1,64}\s?$")
_WRITTEN = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?[0-9]{1,3}|\s(?:dot|DOT)\s[0-9]{1,3}){3}(?![0-9])")


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data: many, and overlapping. At most GROUPS windows begin at each group of digits."""
    out: list[Span] = []
    for m in _AT.finditer(text):
        right = _RIGHT.match(text, m.end())
        left = right and _LEFT.search(text[max(0, m.start() - 65) : m.start()])
        if left:
            out.append(("email", m.start() - len(left[0]), right.end()))
    for m in _WRITTEN.finditer(text):
        out.append(("ip", m.start(), m.end()))
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _DIGITS.finditer(m[0])]
        for i, (lo, _) in enumerate(groups):
            n = 0
            for j in range(i, min(len(groups), i + GROUPS)):
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                hi = groups[j][1]
                if n >= 13:
                    out.append(("card", lo, hi))
                if 7 <= n <= 15:
                    out.append(("phone", lo - (lo > 0 and text[lo - 1] in "+("), hi))
                if j == i + 3 and n <= 12:
                    out.append(("ip", lo, hi))
    return out


# Words that stand near each kind.
CUES = {
    "email": frozenset("mail email e-mail contact write correo courriel kontakt adresse address".split()),
    "ip": frozenset("ip host server address adresse dirección login from connect port".split()),
    "card": frozenset("card visa mastercard credit karte kreditkarte tarjeta carte payment konto account iban".split()),
    "phone": frozenset("tel phone call mobile fax telefon handy teléfono móvil téléphone portable whatsapp number".split()),
}
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
FEATURES = ("email", "ip", "card", "phone", "size", "digits", "groups", "least", "most", "letters", "spaces", "dots", "dashes", "brackets", "slashes", "plus", "double_zero", "at_sign", "at_word", "dot_word", "checks",
            "octets", "labels", "last_label", "inside_left", "inside_right", "more_left", "more_right", "cue", "other_cue", "digits_around", "marks_around")


def described(text: str, span: Span) -> list[float]:
    """FEATURES of a proposal: its form, and AROUND characters on either side."""
    kind, lo, hi = span
    own, before, after = text[lo:hi], text[max(0, lo - AROUND) : lo], text[hi : hi + AROUND]
    groups = _DIGITS.findall(own)
    digits = "".join(groups)
    labels = re.split(r"[.\s]+", own.rpartition("@")[2])
    words = {w.lower() for w in _WORDS.findall(before)} | {w.lower() for w in _WORDS.findall(after[: AROUND // 2])}
    low, around = own.lower(), before + after
    left, right = before[-1:], after[:1]
    return [*(float(kind == k) for k in KINDS), float(len(own)), float(len(digits)), float(len(groups)), float(min(map(len, groups), default=0)), float(max(map(len, groups), default=0)),
            float(sum(c.isalpha() for c in own)), float(own.count(" ")), float(own.count(".")), float(own.count("-")), float(sum(c in "()[]{}<>" for c in own)), float(own.count("/")),
            float(own[:1] == "+"), float(digits[:2] == "00"), float("@" in own), float("at" in re.split(r"[^a-z]+", low)), float("dot" in re.split(r"[^a-z]+", low)),
            float(12 < len(digits) < 20 and luhn(digits)), float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)), float(len(labels)), float(len(labels[-1])),
            float(left.isalnum()), float(right.isalnum()), float(bool(re.search(r"[0-9][ ().+\-/]{0,3}$", before))), float(bool(re.match(r"[ ().\-/]{0,3}[0-9]", after))),
            float(bool(words & CUES[kind])), float(any(words & v for k, v in CUES.items() if k != kind)), float(sum("0" <= c <= "9" for c in around)), float(sum(not (c.isalnum() or c.isspace()) for c in around))]


def _rewritten(kind: str, own: str, pick: int) -> tuple[str, bool]:
    """A base span written otherwise, and whether it still is what it was."""
    digits = _NOT_DIGITS.sub("", own)
    if kind == "email":
        name, _, host = own.partition("@")
        return (f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} (at) {host}", f"{name} at {host.replace('.', ' dot ')}", f"{name} @ {host}")[pick % 4], True
    if kind == "ip":
        if pick % 5 == 0:
            return own.replace(own.rpartition(".")[2], str(256 + pick % 700)), False
        return (own.replace(".", "[.]"), own.replace(".", " dot "), own.replace(".", "(.)"), own.replace(".", " [dot] "))[pick % 4], True
    if kind == "card":
        if pick % 4 == 0:
            return digits[:-1] + str((int(digits[-1]) + 1 + pick % 9) % 10), False
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return (".".join(four), "/".join(four), " - ".join(four), "-".join(four))[pick % 4], True
    if pick % 5 == 0:
        return digits[:7], False
    return (f"00{own[1:]}", f"00{digits}", f"00 {own[1:]}", own[1:].replace("(", "").replace(")", ""))[pick % 4], True


def examples(text: str) -> Iterator[tuple[list[float], str, float, bool, int]]:
    """Features, kind, label, whether the example is free, and the hash of the span (copies share it): all of a text."""
    base, failed = matches(text)
    found = set(base)
    for k, lo, hi in base:
        h = xxhash.xxh64_intdigest(text[lo:hi]) >> 1
        yield described(text, (k, lo, hi)), k, 1.0, False, h
        new, right = _rewritten(k, text[lo:hi], h // 7)
        near = text[max(0, lo - 3 * AROUND) : lo]
        whole, start, stop = near + new + text[hi : hi + 3 * AROUND], len(near), len(near) + len(new)
        yield described(whole, (k, start, stop)), k, float(right), False, h
        for s in proposals(whole):
            if s != (k, start, stop) and s[1] < stop and s[2] > start:
                yield described(whole, s), s[0], 0.0, False, h
    known = sorted((lo, hi) for _, lo, hi in [*base, *failed])
    others = [s for s in proposals(text) if s not in found]
    for s, free in zip(others, _free(others, known), strict=True):
        yield described(text, s), s[0], 0.0, free, xxhash.xxh64_intdigest(text[s[1] : s[2]]) >> 1


class Model:
    """Trees as arrays, a calibration and a threshold for each kind; without trees nothing is added."""

    def __init__(self, trees: list[list[tuple]], weights: list[float], bounds: list[float], values: list[float]) -> None:
        self.trees, self.weights, self.bounds, self.values = trees, weights, bounds, values
        self.least: dict[str, float] = {}

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of rows of features."""
        margin = np.zeros(len(x))
        for nodes, w in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            feature, edge, left, right, value = nodes
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= edge[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            margin += w * value[at]
        return np.interp(np.round(margin, LEVELS), self.bounds, self.values)

    def added(self, text: str, base: list[Span]) -> list[tuple[str, int, int, float]]:
        """Spans beyond the base ones: proposals above their threshold that meet no base span, best first, none meeting a better one."""
        found = [s for s in proposals(text) if s[0] in self.least]
        if not self.trees or not found:
            return []
        taken = sorted((lo, hi) for _, lo, hi in base)
        found = [s for s, free in zip(found, _free(found, taken), strict=True) if free]
        if not found:
            return []
        told = self.score(np.array([described(text, s) for s in found]))
        ranked = sorted((-p, s[1], -s[2], KINDS.index(s[0])) for s, p in zip(found, told, strict=True) if p >= self.least[s[0]])
        out: list[tuple[str, int, int, float]] = []
        held: set[int] = set()
        for p, lo, hi, k in ranked:
            if not any(i in held for i in range(lo, -hi)):
                held.update(range(lo, -hi))
                out.append((KINDS[k], lo, -hi, -p))
        return out


def _free(found: list[Span], taken: list[tuple[int, int]]) -> Iterator[bool]:
    """Whether each span meets none of the taken ones."""
    starts = np.array([lo for lo, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([hi for _, hi in taken], np.int64)) if taken else starts
    for _, lo, hi in found:
        i = np.searchsorted(starts, hi)
        yield not (i and reach[i - 1] > lo)


def _nodes(tree) -> tuple[np.ndarray, ...]:
    """A fitted tree as arrays: feature (-1 in a leaf), threshold, children, value."""
    rows: list[list] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.subtreeDepth():
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
        return at

    walk(tree._java_obj.rootNode())
    return tuple(np.array(c) for c in zip(*rows, strict=True))


def training_examples(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``x, kind, label, free, h``: the distinct examples of every text; a null one has none."""
    schema = pa.schema([("x", pa.list_(pa.float64())), ("kind", pa.string()), ("label", pa.float64()), ("free", pa.bool_()), ("h", pa.int64())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (e for b in batches for text in b.column(0) for e in examples(text.as_py()))
        while found := list(itertools.islice(every, HELD)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    texts = docs.where(F.col(text_col).isNotNull()).select(text_col)
    return small_batches(texts).mapInArrow(tell, "x array<double>, kind string, label double, free boolean, h long").distinct()


def fit_model(docs: DataFrame, *, text_col: str = "text", precision: float = PRECISION, seed: int = 7) -> Model:
    """Trees from all texts' examples, calibrated on those whose span's hash puts them into a third that the trees have not seen.

    A kind's threshold lies half-way between the least calibrated probability that has ``precision`` among the held-out examples at or
    above it, and at most FREE free ones there for each right one, and the next lower probability; at 0.5 at least. A kind without one
    adds nothing. Rows without a text teach nothing. MLlib takes the trees' candidate edges from a sample of the examples, as it always
    does; every example counts in the choice among them.
    """
    told = cut(training_examples(docs, text_col=text_col).withColumn("held", F.col("h") % 3 == 0))
    counts = {(r["held"], r["label"]): r["n"] for r in told.groupBy("held", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get((held, label), 0) for held in (False, True) for label in (0.0, 1.0)) < LEAST:
        return Model([], [], [0.0, 1.0], [0.0, 0.0])
    vectors = told.withColumn("_x", array_to_vector("x"))
    trees = GBTClassifier(featuresCol="_x", labelCol="label", maxDepth=4, maxIter=12, stepSize=0.3, minInstancesPerNode=LEAST, seed=seed).fit(vectors.where("not held"))
    raw = trees.transform(vectors.where("held")).withColumn("_raw", F.bround(vector_to_array("rawPrediction")[1], LEVELS))
    levels = cut(raw.groupBy("kind", "_raw").agg(F.sum("label").alias("right"), F.count_if(~F.col("free")).alias("n"), F.count_if("free").alias("free")))
    sure = levels.where("n > 0").groupBy("_raw").agg((F.sum("right") / F.sum("n")).alias("label"), F.sum("n").cast("double").alias("weight"))
    fitted = IsotonicRegression(featuresCol="_raw", labelCol="label", weightCol="weight").fit(sure)
    model = Model([_nodes(t) for t in trees.trees], list(trees.treeWeights), [float(v) for v in fitted.boundaries], [float(v) for v in fitted.predictions])
    held = levels.collect()  # a row for each kind and level
    for kind in KINDS:
        ranked = sorted(((float(np.interp(r["_raw"], model.bounds, model.values)), r["right"], r["n"], r["free"]) for r in held if r["kind"] == kind), reverse=True)
        right = total = free = 0
        for i, (p, k, n, m) in enumerate(ranked):
            right, total, free = right + k, total + n, free + m
            if right >= precision * total and free <= FREE * right and total >= LEAST and (i + 1 == len(ranked) or ranked[i + 1][0] < p):
                model.least[kind] = max((p + (ranked[i + 1][0] if i + 1 < len(ranked) else p)) / 2, 0.5)
    return model


SPAN = "struct<kind:string,start:int,stop:int,score:double>"


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """``doc_id, base, added, redacted`` for every row of ``docs``: spans of the base rules, spans that the model adds, in code points and in
    order, and the text with ``<KIND>`` in their place.

    Null texts count as empty and have none. Rows with equal texts have equal spans. Base spans of different kinds may overlap; what is
    redacted then bears the kind of the first. Null and repeated ids are passed on. An empty table gives an empty result; other columns,
    whatever their names, play no part. Texts with fewer than LEAST examples of a class in all add nothing.
    """
    model = fit_model(docs, text_col=text_col, **fit)

    def told(text: str) -> tuple:
        base = base_spans(text)
        added = sorted(model.added(text, base), key=lambda s: (s[1], KINDS.index(s[0])))
        out, at = [], 0
        for kind, lo, hi in sorted([*base, *(s[:3] for s in added)], key=lambda s: (s[1], KINDS.index(s[0]))):
            if lo >= at:
                out.append(f"{text[at:lo]}<{kind.upper()}>")
            at = max(at, hi)
        as_span = lambda s: {"kind": s[0], "start": s[1], "stop": s[2], "score": s[3] if len(s) > 3 else 1.0}
        return [as_span(s) for s in base], [as_span(s) for s in added], "".join([*out, text[at:]])

    def make():
        return lambda texts: dict(zip(("base", "added", "redacted"), zip(*map(told, texts), strict=True), strict=True))

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return per_row(rows, make, f"base array<{SPAN}>, added array<{SPAN}>, redacted string")


def _listed(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data_digests(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, the base spans of each kind counted, ``base_sha256`` of their list, ``spans``, the list of all, and ``n_added``.

    A list has ``kind:start:end`` by start and then kind in the order of KINDS. Edge cases as in :func:`find_personal_data`.
    """
    told = find_personal_data(docs, **options)
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    every = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(F.struct(a["start"], rank(a)) < F.struct(b["start"], rank(b)), -1).when(F.struct(a["start"], rank(a)) > F.struct(b["start"], rank(b)), 1).otherwise(0))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return told.select("doc_id", *map(of, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
