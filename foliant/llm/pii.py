"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

1. Generators propose spans by regular expressions, with more recall than precision: the four base patterns before their
   checks, e-mail addresses with the sign spelled out, telephone numbers without a country code. One pass over the
   texts writes, per document, how far its candidates lie apart and a few small features of their format and context.
2. Running sums give places. A candidate that is, or overlaps, a checked base span counts as an example; a match of a
   base pattern that fails its check counts against. Candidates of the other generators have no label unless a base
   span covers them: they are neither learned from nor counted, however frequent they are. Since all features are
   small integers, the whole corpus folds into one short table of counts.
3. For each kind, trees of two levels are boosted on the table of one half of its labelled candidates, and its threshold
   is calibrated on that of the other half: the least score at which ``PRECISION`` is reached. Features that define a
   base span (its generator, its sign, its prefix) are left out, so look-alikes in the same format and context score
   as high. A kind without labels has nothing against it: its candidates score one half and are added.
4. The trees become a SQL expression. Base spans stay; candidates beside them are added from the threshold on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.staging import stage

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 12
RATE = 0.5
PRECISION = 0.95
LEAST_SCORE = 0.5  # no threshold is below it
CONTEXT = 24  # code points before a candidate that are looked at

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Generator: kind, pattern, a cheap test that a text must pass. The first four find just what the base patterns
# find; look-behinds and possessive runs keep the engine from starting again within a run.
GENERATORS = [
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]"),
    ("email", rf"(?i)(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++", r"(?i)[(\[]at[)\]]"),
    ("phone", r"(?<![0-9])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
]
BASE = 4  # generators that are the base patterns
HINTS = r"(?i)\b(?:e-?mail|mail|contact|tel|phone|call|mobile|fax|card|visa|credit|ip|address|host)\b"
FEATURES = ["luhn", "n_digits", "format", "before", "after", "hint"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 16 to 19 digits pass the check sum; false for other lengths."""
    n = F.length(digits)
    digit = lambda i: F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48  # noqa: E731  from the right
    weighed = lambda i: F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + weighed(i))
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _class(c: Column) -> Column:
    """0 nothing or white space, 1 letter, 2 digit, 3 other."""
    return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).otherwise(3)


def _candidate(generator: int, match: Column, gap: Column, next_gap: Column, i: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    luhn = _luhn(digits) if generator == 2 else F.lit(False)
    checks = {0: F.lit(True), 1: match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 2: luhn, 3: n.between(8, 15)}
    shape = F.when(match.rlike(r"[()\[\]]"), 4).when(match.contains("-"), 3).when(match.contains("."), 2).when(match.contains(" "), 1).otherwise(0)
    return F.struct(
        F.lit(generator).alias("generator"), i.alias("i"), F.length(gap).alias("gap"), F.length(match).alias("len"),
        checks.get(generator, F.lit(False)).alias("base"), luhn.cast("int").alias("luhn"),
        F.when(n < 8, 0).when(n < 10, 1).when(n < 12, 2).when(n < 16, 3).when(n == 16, 4).when(n < 20, 5).otherwise(6).alias("n_digits"),
        shape.alias("format"), _class(F.right(gap, F.lit(1))).alias("before"), _class(F.left(next_gap, F.lit(1))).alias("after"),
        F.right(gap, F.lit(CONTEXT)).rlike(HINTS).cast("int").alias("hint"),
    )


def _found(text: Column, generator: int) -> Column:
    kind, pattern, test = GENERATORS[generator]
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    each = F.transform(
        F.array(F.struct(matches.alias("m"), gaps.alias("g"))),
        lambda x: F.transform(x["m"], lambda m, i: _candidate(generator, m, F.get(x["g"], i), F.get(x["g"], i + 1), i)),
    )[0]
    return F.when(text.rlike(test) if len(test) > 1 else text.contains(test), each)


def candidates(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (columns ``keep`` and a number ``row``), and their candidates with places and features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.concat(*[F.coalesce(_found(text, g), F.array()) for g in range(len(GENERATORS))]).alias("pii candidates"))
    rows = stage(rows.withColumn("pii row", F.monotonically_increasing_id()), "candidates")
    flat = rows.where(F.size("pii candidates") > 0).select(F.col("pii row").alias("row"), F.inline("pii candidates"))
    before = Window.partitionBy("row", "generator").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    flat = flat.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    kinds = F.array(*[F.lit(KINDS.index(g[0])) for g in GENERATORS])
    flat = flat.withColumn("kind", F.get(kinds, F.col("generator")))
    by_place = Window.partitionBy("row", "kind").orderBy("start", "end", "generator")
    left = F.max(F.when(F.col("base"), F.col("end"))).over(by_place)
    right = F.min(F.when(F.col("base"), F.col("start"))).over(by_place.rowsBetween(0, Window.unboundedFollowing))
    return rows, flat.withColumn("covered", F.coalesce(left > F.col("start"), F.lit(False)) | F.coalesce(right < F.col("end"), F.lit(False)))


class Trees:
    """Boosted trees of two levels on counted rows of small integers, and their SQL."""

    def __init__(self, rows: np.ndarray, positive: np.ndarray, count: np.ndarray):
        share = (positive.sum() + 1) / (count.sum() + 2)
        self.first = float(np.log(share / (1 - share)))
        self.trees: list[tuple] = []
        total = np.full(len(rows), self.first)
        for _ in range(ROUNDS if len(rows) else 0):
            chance = 1 / (1 + np.exp(-total))
            slope, curve = positive - count * chance, count * chance * (1 - chance)
            tree = self._grow(rows, slope, curve, np.ones(len(rows), bool), 2)
            self.trees.append(tree)
            total += self._value(tree, rows)

    def _grow(self, rows, slope, curve, here, depth):
        leaf = RATE * float(slope[here].sum() / (curve[here].sum() + 1))
        best = None
        for k in range(rows.shape[1]) if depth else ():
            for v in np.unique(rows[here, k]).tolist():
                yes = here & (rows[:, k] == v)
                no = here & ~yes
                gain = sum(slope[x].sum() ** 2 / (curve[x].sum() + 1) for x in (yes, no))
                if yes.any() and no.any() and (best is None or gain > best[0] + 1e-9):
                    best = (gain, k, v, yes, no)
        if best is None:
            return leaf
        _, k, v, yes, no = best
        return (k, v, self._grow(rows, slope, curve, yes, depth - 1), self._grow(rows, slope, curve, no, depth - 1))

    def _value(self, tree, rows):
        if not isinstance(tree, tuple):
            return np.full(len(rows), tree)
        k, v, yes, no = tree
        return np.where(rows[:, k] == v, self._value(yes, rows), self._value(no, rows))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.first + sum((self._value(t, rows) for t in self.trees), np.zeros(len(rows))))))

    def sql(self) -> str:
        def of(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{tree!r}D"
            return f"if({FEATURES[tree[0]]} = {tree[1]}, {of(tree[2])}, {of(tree[3])})"

        return f"1 / (1 + exp(-({' + '.join([f'{self.first!r}D', *map(of, self.trees)])})))"


def fit(flat: DataFrame) -> tuple[list[Trees], list[float]]:
    """The trees and a threshold for each kind (2 where no score is precise enough)."""
    half = F.pmod(F.xxhash64("start", "end", "kind"), F.lit(2)).alias("half")  # alike however rows are dealt
    labelled = flat.where((F.col("generator") < BASE) | F.col("covered"))
    # A row per combination of small integers: its size does not depend on the corpus.
    table = labelled.groupBy(half, "kind", *FEATURES).agg(F.sum((F.col("base") | F.col("covered")).cast("long")).alias("yes"), F.count(F.lit(1)).alias("n")).orderBy("half", "kind", *FEATURES).collect()
    matrix = lambda rows: np.array([[r[f] for f in FEATURES] for r in rows], np.int64).reshape(-1, len(FEATURES))
    column = lambda rows, name: np.array([r[name] for r in rows], float)
    models, thresholds = [], []
    for kind in range(len(KINDS)):
        learn, check = ([r for r in table if r["kind"] == kind and r["half"] == h] for h in (0, 1))
        trees = Trees(matrix(learn), column(learn, "yes"), column(learn, "n"))
        models.append(trees)
        score, yes, n = trees.scores(matrix(check)), column(check, "yes"), column(check, "n")
        order = np.argsort(-score, kind="stable")
        precision = np.cumsum(yes[order]) / np.maximum(np.cumsum(n[order]), 1)
        last = np.append(np.diff(score[order]) != 0, True)[: len(order)]  # rows of one score go together
        good = np.flatnonzero((precision >= PRECISION) & last)
        if len(good) and good[-1] + 1 < len(order):  # half way to the next score, which is not precise enough
            thresholds.append(max(LEAST_SCORE, float(score[order][good[-1] : good[-1] + 2].mean())))
        else:
            thresholds.append(2.0 if len(order) and not len(good) else LEAST_SCORE)
    return models, thresholds


def spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row, with ``base`` and ``found``: arrays of (kind, start, end), sorted; code points, end exclusive.

    ``kind`` counts from 0 in the order of KINDS. Null texts are empty and have none. Repeated rows are judged each;
    an empty table gives no rows.
    """
    rows, flat = candidates(docs, keep)
    models, thresholds = fit(flat)
    flat = flat.withColumn("score", F.expr(f"case {' '.join(f'when kind = {k} then {trees.sql()}' for k, trees in enumerate(models))} end"))
    enough = F.col("score") >= F.get(F.array(*map(F.lit, thresholds)), F.col("kind"))
    span = F.struct(F.col("kind"), F.col("start"), F.col("end"))
    chosen = flat.where(F.col("base") | ~F.col("covered") & enough)
    per_row = chosen.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_set(span)).alias("found")
    )
    none = F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>")
    joined = rows.select(*[F.col(f"`{c}`").alias(f"kept {c}") for c in keep], F.col("pii row").alias("row")).join(per_row, "row", "left")
    return joined.select(*[F.col(f"`kept {c}`").alias(c) for c in keep], F.coalesce("base", none).alias("base spans"), F.coalesce("found", none).alias("found spans"))


def joined(c: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, a digest of the base spans, and all spans."""
    found = spans(docs, ["doc_id"])
    base = F.col("base spans")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each span in ``text`` replaced by its kind in brackets; null texts stay null.

    Spans that overlap are replaced as one, named by the first.
    """
    found = spans(docs, docs.columns)
    by_place = F.array_sort(F.transform("found spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    reached = lambda all_, i: F.coalesce(F.array_max(F.transform(F.slice(all_, 1, i), lambda s: s["end"])), F.lit(0).cast("long"))
    text = F.col("text")
    piece = lambda lo, hi: F.substring(text, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def masked(all_: Column) -> Column:
        pieces = F.transform(all_, lambda s, i: F.when(s["start"] >= reached(all_, i), F.concat(piece(reached(all_, i), s["start"]), F.get(names, s["kind"]))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), piece(reached(all_, F.size(all_)), F.length(text)))

    new = F.when(F.size("found spans") > 0, F.transform(F.array(by_place), masked)[0]).otherwise(text)
    return found.select(*[new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
