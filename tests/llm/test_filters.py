"""Toxicity, personal data, licences, leaks and the pipeline."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import decontamination, licences, minhash, pii, queries, toxicity
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


@pytest.fixture(scope="module")
def private(spark):
    rng = random.Random(4)
    signs = ["@", ".", " ", "-", "+", "(", ")", "1", "23", "4111111111111111", "a", "b.c", "é😀", "255", "300", "\n", "_", " 1.2.3.4 ", "x@y.zz", "+1 555 123 4567"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "call +49 (30) 1234-567 or 017 555-7713", "9" * 5000, "1 " * 3000, "a" * 3000 + "@" + "b.c" * 500, "a.b@" * 500]
    rows = [(i, t, "x", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long").repartition(4)


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_spans_stay(private):
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    found = pii.summary(private).collect()
    assert len(found) == len(texts)
    for r in found:
        want = [f"{k}:{lo}:{hi}" for k, lo, hi in base_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _, _ in BASE] == [sum(w.startswith(k) for w in want) for k, _, _ in BASE]
        assert set(want) <= set(r["spans"].split(",")) | {""} - ({""} if want else set())


def test_redaction(private):
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    spans = {r["doc_id"]: r["spans"] for r in pii.summary(private).collect()}
    for r in pii.redact(private).collect():
        text, made, at = texts[r["doc_id"]], "", 0
        for lo, hi, kind in sorted((int(x), int(y), pii.KINDS.index(k)) for k, x, y in (s.split(":") for s in spans[r["doc_id"]].split(",") if s)):
            if lo >= at:
                made += f"{text[at:lo]}[{pii.KINDS[kind].upper()}]"
            at = max(at, hi)
        assert r.__fields__ == ["doc_id", "text", "base", "n_chars"]
        assert r["text"] == (text if text is None else made + text[at:])


def test_spans_are_replaced_in_place(spark):
    docs = spark.createDataFrame([(1, "é😀 mail a@b.co, ip 1.2.3.4 end")], "doc_id long, text string")
    assert pii.redact(docs).first()["text"] == "é😀 mail [EMAIL], ip [IP] end"


@pytest.mark.parametrize(("base", "added"), [(300, 3), (20, 300), (0, 40)])
def test_added_spans_are_found_rare_or_frequent(spark, base, added):
    """Spelled-out addresses and numbers without country code beside base spans and beside matches that fail their check."""
    texts = [f"please mail some.one{i}@host{i}.com or call +1 (555) 123-{i:04d} soon" for i in range(base)]
    texts += [f"number {'4111111111111112'} and +{i % 10}-{i % 7} then" for i in range(60)]
    extra = [(f"other{i} [at] site{i}.org", f"555-{100 + i}-{1000 + i}") for i in range(added)]
    texts += [f"please mail {a} or call {b} soon" for a, b in extra]
    texts = ["so " * (i % 7) + t for i, t in enumerate(texts)]  # matches of one kind at many places
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["spans"] for r in pii.summary(docs).collect()}
    for i, (address, number) in enumerate(extra, base + 60):
        lo, at = texts[i].index(address), texts[i].index(number)
        want = {f"email:{lo}:{lo + len(address)}"} | ({f"phone:{at}:{at + len(number)}"} if base else set())
        assert want <= set(found[i].split(","))
    assert not [s for i in range(base, base + 60) if (s := found[i])]


def test_toxicity_of_held_out_rows(spark):
    found = queries.ftrl_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, predicted = found["toxic"] == 1, found["predicted"] == 1
    assert (toxic & predicted).sum() >= 0.85 * toxic.sum()
    assert (toxic & predicted).sum() >= 0.95 * predicted.sum()


def test_toxicity_edges(corpus):
    labels = corpus.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    found = toxicity.toxic_scores(corpus, labels, ["doc_id"]).collect()
    assert len(found) == corpus.count() and all(0 <= r["score"] <= 1 for r in found)
    nobody = toxicity.toxic_scores(corpus, labels.where("false"), ["doc_id"]).collect()
    assert len(nobody) == corpus.count() and max(r["score"] for r in nobody) < toxicity.THRESHOLD
    assert toxicity.toxic_scores(corpus.where("false"), labels, ["doc_id"]).count() == 0
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in labels.where("doc_id is not null").select("doc_id", toxicity.held_out("doc_id").alias("h")).collect())


def test_known_licences(spark):
    assert all(re.search(licences.MARKS, text) for _, _, text in licences.KNOWN)
    mit = licences.KNOWN[1][2].replace("MIT License", "MIT LICENCE\n\nCopyright (c) 2020 Some One").replace(" sublicense", "\n  sub-license")
    rows = [(1, mit, "x"), (2, "Some prose.\nReleased  under the MIT licence!\nmore", "x"), (3, "Released under the MIT License. And more", "x"), (4, None, "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit string")
    found = {tuple(r) for r in licences.scan(docs).collect()}
    assert (1, "document", 0, "MIT", "text") in found and (2, "line", 1, "MIT", "notice") in found
    assert not {r for r in found if r[0] > 2}


def test_common_and_given_licences(spark):
    bsd = next(t for name, form, t in licences.KNOWN if name == "BSD-3-Clause" and form == "text")
    texts = [
        f"Copyright (c) 2001, A. Body\n{bsd}".replace("must", "MUST"), "SPDX-License-Identifier: LGPL-2.1-or-later", "// code\n\n" + licences._MPL_HEADER,
        "Grant  of Own Terms, one!", "SPDX-License-Identifier: Own",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["unit"], r["licence"]) for r in licences.scan(docs).collect()}
    assert {(0, "document", "BSD-3-Clause"), (1, "line", "LGPL-2.1"), (2, "paragraph", "MPL-2.0")} <= found and {r[0] for r in found} == {0, 1, 2}
    own = spark.createDataFrame([("Own", "text", "grant of own terms one"), ("None", "text", "...")], "licence string, form string, text string")
    assert (3, "document", "Own") in {(r["doc_id"], r["unit"], r["licence"]) for r in licences.scan(docs, own).collect()}


def test_leaks(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(8, 40))) for i in range(30)] + [(90, None), (91, "short"), (None, prose(rng, 20))]

    def edited(text, n):
        signs = list(text)
        for _ in range(n):
            at = rng.randrange(len(signs))
            signs[at : at + rng.randrange(2)] = rng.choice(["", "q", "zz"])
        return "".join(signs)

    rows, want = [], set()
    for i, text in items[:30]:
        n = sum(c.isalnum() for c in text)
        for k, edits in enumerate((0, int(n * decontamination.EDITS) // 2)):
            rows.append((10 * i + k, f"{prose(rng, 30)}\n{edited(text, edits).upper()}*** {prose(rng, 10)}", "x"))
            want.add((10 * i + k, i))
    rows += [(1000 + i, prose(rng, 80), "x") for i in range(40)] + [(2000, None, "x"), (2001, "", "x")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    texts = {r[0]: r[1] for r in rows}
    squeeze = lambda t: "".join(c for c in t.lower() if c.isalnum())
    assert all(squeeze(texts[r["doc_id"]][r["start"] : r["end"]]) == squeeze(dict(items)[r["item_id"]]) for r in found if r["edits"] == 0)
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(texts) - {d for d, _ in want}
    assert decontamination.leaks(docs, bench.where("false")).count() == 0 and decontamination.leaks(docs.where("false"), bench).count() == 0


def test_short_items_are_found_exactly(spark):
    items = [(1, "What is the capital of France?"), (2, "Who won?"), (3, "首都"), (4, "cat"), (5, "..."), (6, "Who won?")]
    texts = ["Quiz: WHAT is the capital, of France - Paris", "what is the capitol of France", "so who  won the cup", "法国的首都是哪里", "concatenate", "a Cat. cat", "whowonder"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], texts[r["doc_id"]][r["start"] : r["end"]], r["edits"]) for r in decontamination.leaks(docs, bench).collect())
    assert found == [(0, 1, "WHAT is the capital, of France", 0), (2, 2, "who  won", 0), (2, 6, "who  won", 0), (3, 3, "首都", 0), (5, 4, "Cat", 0), (5, 4, "cat", 0)]
    assert {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()} == {1, 4, 6}


def test_short_items_are_whole_words(spark):
    texts = ["Roman art exhibits", "see an ART-exhibit, now", "an art exhibit"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "An art exhibit")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.leaks(docs, bench).collect()) == [1, 2]


def test_rows_are_judged_by_their_own_text(spark):
    """Leaks and copies among rows without doc_id and rows that share one."""
    rng = random.Random(5)
    item, clean, other = prose(rng, 30), prose(rng, 40), prose(rng, 40)
    rows = [(None, item), (None, clean), (4, item), (4, other), (4, other), (None, clean), (9, clean), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    count = lambda found: sorted((str(r["doc_id"]), str(r["text"])) for r in found)
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns and count(left.collect()) == count([dict(zip(("doc_id", "text"), r)) for r in rows if r[1] != item])
    one = minhash.drop_near_duplicates(docs)
    want = [(None, None), (None, ""), (4, item), (4, other), (9, clean)]
    assert one.columns == docs.columns and count(one.collect()) == count([dict(zip(("doc_id", "text"), r)) for r in want])
    assert decontamination.decontaminate(docs.where("false"), bench).count() == minhash.drop_near_duplicates(docs.where("false")).count() == 0


def test_parts_of_long_items_are_found(spark):
    rng = random.Random(3)
    item = prose(rng, 120)
    half, middle = item[: len(item) // 2], item[400:540]
    texts = [f"{prose(rng, 30)} {x} {prose(rng, 30)}" for x in (half, middle, item, item[:30], item[:300].replace("a", "4", 4))]
    texts.append(f"{item[-200:]} {prose(rng, 40)} {half}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {}
    for r in decontamination.leaks(docs, bench).collect():
        found.setdefault(r["doc_id"], []).append((texts[r["doc_id"]][r["start"] : r["end"]], r["edits"]))
    assert set(found) == {0, 1, 2, 4, 5} and found[2] == [(item, 0)]
    assert [len(found[k]) for k in (0, 1, 4, 5)] == [1, 1, 1, 2]
    assert half.strip() in found[0][0][0] and found[0][0][1] <= 3  # the last segment may reach beyond the half, at an edit a sign
    assert middle.strip() in found[1][0][0] and 0 < found[4][0][1] <= 4


def test_pipeline(spark):
    """Each stage against the operator's own decisions on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, SF)
        assert after.columns == columns
        before, kept = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, after))
        assert set(kept) <= set(before) and len(kept) >= 0.8 * len(before)
        assert kept == {k: before[k] for k in kept} if name != "pii" else set(kept) == set(before)
        docs = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
