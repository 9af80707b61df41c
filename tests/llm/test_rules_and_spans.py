"""Operators that learn decide something: many mined rules on urls, secrets without any cue word, languages and verdicts by a plain reading."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import crf, lang_id, quality, secrets, url_filter


@pytest.fixture(scope="module")
def pages(spark):
    """Seventy bad hosts and thirty bad words in paths of good hosts, 30 pages each; other words are innocent."""
    rng = random.Random(4)
    rows = []
    for k in range(70):
        rows += [(f"http://bad{k}.example{k % 7}.com/a/{rng.randrange(9)}/{rng.randrange(10**6)}.html", True) for _ in range(30)]
    for k in range(30):
        rows += [(f"http://h{rng.randrange(10**6)}.org/x/vice{k}/{rng.randrange(10**6)}", True) for _ in range(30)]
    rows += [(f"http://h{rng.randrange(10**6)}.{rng.choice(['org', 'com'])}/{rng.choice('axyz')}/{rng.randrange(9)}/{rng.randrange(10**6)}.html", False) for _ in range(12_000)]
    rng.shuffle(rows)
    return [(i, u, b) for i, (u, b) in enumerate(rows)]


def test_many_rules_are_mined_and_match(spark, pages):
    rows = spark.createDataFrame([(i, u) for i, u, _ in pages], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, _, b in pages if i % 4], "doc_id long, quality int, toxic int")
    rules = url_filter.mine(rows, labels)
    assert len(rules) >= 50 and all(c >= url_filter.MIN_CONFIDENCE for _, c, _ in rules)
    got = {r.page_id: r for r in url_filter.judge(rows, labels, rules=()).collect()}
    toks = {r.page_id: set(r.t) for r in rows.select("page_id", url_filter.tokens("url", url_filter.host(), url_filter.path()).alias("t")).collect()}
    for i, _, bad in pages:
        best = max((c for own, c, _ in rules if set(own) <= toks[i]), default=None)
        assert (got[i].verdict == "block") == (best is not None) and got[i].confidence == best
    hit = sum(got[i].verdict == "block" for i, _, b in pages if b) / sum(b for *_, b in pages)
    wrong = sum(got[i].verdict == "block" for i, _, b in pages if not b)
    assert hit > 0.95 and wrong < 0.01 * len(pages)


def test_levels_give_the_rules_of_growth(spark, pages, monkeypatch):
    rows = spark.createDataFrame([(i, u) for i, u, _ in pages[:3000]], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, _, b in pages[:3000]], "doc_id long, quality int, toxic int")
    items = rows.select(F.col("page_id").alias("doc_id"), url_filter.tokens("url", url_filter.host(), url_filter.path()).alias("items")).join(labels, "doc_id").select("items", (F.col("quality") == 0).alias("bad"))
    assert url_filter.rules_of(items, 8, 0.8) == url_filter.rules_of(items, 8, 0.8, max_sets=0)


def test_secrets_without_cues(spark):
    rng = random.Random(11)
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    words = [a + b for a in ("ba", "ce", "di", "fo", "gu", "lo") for b in ("ran", "ten", "mi", "po", "sul", "x")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    key = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    learnt = [(i, f"{prose(20)} token: {key(32)} {prose(20)}") for i in range(150)] + [(i, f"{prose(30)} {rng.choice(words)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com {rng.randrange(10**9)} {prose(10)}") for i in range(150, 400)]
    planted = {1000 + i: key(32) for i in range(60)}
    innocent = [(2000 + i, f"{prose(15)} {rng.choice(['Order', 'call', 'see'])} {rng.choice([f'{rng.randrange(10**9)}', f'{rng.choice(words)}.{rng.randrange(99)}@mail.example.com', '2024-05-17', 'v1.2.3', 'B2B'])} {prose(15)}") for i in range(300)]
    rows = learnt + [(i, f"{prose(15)} {k} {prose(15)}") for i, k in planted.items()] + innocent
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, found = dict(rows), {}
    for r in secrets.find(docs, secrets.train(docs)).collect():
        found[r.doc_id] = {text[r.doc_id][s.start : s.end] for s in r.found if s.kind == "crf"}
    right = sum(k in found[i] for i, k in planted.items())
    false = sum(len(v - {planted.get(i)}) for i, v in found.items())
    assert right >= 0.9 * len(planted) and false <= 0.1 * right, (right, false)


def test_languages_are_those_of_a_plain_reading(spark):
    """Profiles counted letter by letter in Python, compared by cosines in double precision."""
    rng = random.Random(3)
    sounds = {"aa": "bdgaeiou", "bb": "ptkaeiyw", "cc": "шжащеиоу"}
    rows = [(i, "".join(rng.choice(sounds[k] + " ") for _ in range(rng.randrange(1, 200))), k) for i, k in enumerate(rng.choice(sorted(sounds)) for _ in range(240))]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 !", None), (503, "бщж", None), (None, "dag", "aa"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b, c = (v.astype(float) for v in lang_id.letter_vectors(lang_id.DIM))
    classes = lang_id._classes()

    def vector(text):
        x, out = [lang_id.GAP], np.zeros(lang_id.DIM)
        for k in (int(classes[ord(ch)]) for ch in text):
            if k != lang_id.GAP or x[-1] != lang_id.GAP:
                x.append(k)
        x.append(lang_id.GAP)
        for i in range(len(x) - 2):
            out += a[x[i]] * b[x[i + 1]] * c[x[i + 2]]
        return out

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    near = {r.doc_id: r for r in lang_id.identify(docs).collect()}
    models = lang_id.prototypes(docs.where(~lang_id.held_out()))
    assert set(models) == set(sounds) and near[500].lang_pred == near[501].lang_pred == near[502].lang_pred == "und"
    for i, text, _ in rows:
        if text and text.strip("12 !") and not text.startswith(" ") and not text.endswith(" "):
            v = vector(text)
            cos = {k: float(v @ m) / np.linalg.norm(v) for k, m in models.items()}
            best = max(sorted(cos), key=cos.get)
            assert near[i].lang_pred == best and abs(near[i].score - min(1, max(0, cos[best]))) < 1e-4 and near[i].held_out == held(i)


def test_verdicts_follow_from_line_labels(spark):
    """kept is the base rule and the share of content words in lines that the chain calls content."""
    rng = random.Random(5)
    words = [a + b for a in ("ba", "ce", "di", "fo") for b in ("ran", "ten", "mi", "po")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(160):
        good = i % 2
        rows.append((i, "\n".join(line(rng.randrange(12, 30)) + "." if good or rng.random() < 0.2 else rng.choice(["Home | About | Login", "Click here >> $$$", "Share * Tweet * Like"]) for _ in range(12)), good))
    rows += [(900, None, 1), (901, "", 0), (902, line(10), 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert isinstance(model, crf.Chain)
    text = {i: t or "" for i, t, _ in rows}
    for r in quality.judge(docs, model).collect():
        own = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in text[r.doc_id].split("\n")]
        content = sum(len(w) for w, mark in zip(own, r.line_labels) if mark == quality.CONTENT)
        assert r.content_words == content and r.kept == (not r.base_failed and content >= quality.MIN_SHARE * sum(map(len, own)))
    kept = {r.doc_id for r in quality.judge(docs, model).where("kept").collect()}
    assert {i for i, _, q in rows if q and i < 900} <= kept and len([i for i, _, q in rows if not q and i in kept]) < 8


def test_lines_are_decoded_as_the_best_of_all_sequences():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, k = int(rng.integers(1, 7)), 2
        model = crf.Chain(rng.standard_normal((k, 3)), rng.standard_normal((k, k)), rng.standard_normal(k))
        x = rng.standard_normal((n, 3))
        scores = x @ model.weights.T
        value = lambda y: model.start[y[0]] + sum(scores[i, c] for i, c in enumerate(y)) + sum(model.moves[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product(range(k), repeat=n), key=value)
        assert tuple(crf.viterbi(model, scores, np.array([0, n]))) == best
