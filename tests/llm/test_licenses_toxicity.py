import re
import zlib

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.llm import licenses, toxicity

TEXTS = [
    "Licensed under CC-BY 4.0", "GNU General Public License, version 3 or later", "All Rights Reserved.", "the mit license", None, "", "plain prose about nothing", "cc by cc by\ncc, by",
    "general public  license; ALL RIGHTS\treserved cc_by", "cc byé éall rights reserved", "Apache License, Version 2.0 (the License)", "soccer by night", "SPDX-License-Identifier: MIT", "x " * 60_000 + "all rights reserved",
    "This work is under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc by" * 3, "GPL-2.0-only", "lgpl v2.1", "bsd 3-clause license", "İcc by all rights reserved K",
    "tcl t\u212a license", "TCL TK license", "  (c) Mozilla Public License 2.0; MPL license v1.1!", ".", " . ", "a", ".a.", "cc by \u0130\n", "x11 license and XÉ license",
]


def slow_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def slow_labels(text):
    """Every rule by re, then suppression pair by pair."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm = f" {' '.join(words)} "
    hits = []
    for label, priority, keyword, expression, base in licenses.rules():
        if keyword in norm:
            for m in re.finditer(f"(?<= )({expression})(?= )", norm):
                a, z = norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" ")
                hits.append((a, -z, -priority, label, base))
    hits.sort()
    kept = set()
    for n, (a, z, p, label, base) in enumerate(hits):
        if base or not any(o[0] <= a and o[1] <= z and o[2] <= p for o in hits[:n]):
            kept.add(label)
    return ",".join(sorted(kept))


def test_license_scan(frame, documents):
    texts = TEXTS + [r.text for r in documents.collect()]
    got = {r.doc_id: r for r in licenses.scan(frame(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(t), t
        assert r.labels == slow_labels(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert got[0].labels == "cc-by,cc-by-4.0,licensed" and "gpl-3.0-or-later" in got[1].labels and got[10].labels.startswith("apache-2.0")
    assert licenses.scan(frame(["x"]).where("false")).count() == 0


def test_license_plan_is_native(frame):
    plan = licenses.scan(frame(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert len(licenses.rules()) > 200 and all(re.compile(r[3]) for r in licenses.rules())


def test_every_rule_passes_the_gate():
    """Strings drawn from a rule's expression hold its keyword and an anchor, so that neither gate loses a match."""
    cc = re.compile(r"(?<![a-z0-9])cc(?:0|[\x00-\x2F\x3A-\x60\x7B-\x7F]+by)")

    def check(label, keyword, text):
        assert keyword in text, (label, text)
        assert any(a in text for a in licenses.ANCHORS if a != "cc") or cc.search(text), (label, text)

    def drawn(label, keyword, expression):
        test = given(st.from_regex(re.compile(expression, re.ASCII), fullmatch=True))(lambda text: check(label, keyword, text))
        settings(max_examples=8, deadline=None, database=None, suppress_health_check=list(HealthCheck))(test)()

    for label, _, keyword, expression, _ in licenses.rules():
        drawn(label, keyword, expression)


def test_counterfactual_pairs_swap_terms_only():
    pairs = toxicity.counterfactual_pairs(["The women, the men and Gay people are here", "no group at all"])
    assert len(pairs) == 6
    for a, b in pairs:
        if "women" in a:
            assert {x for x, y in zip(a.split(), b.split(), strict=True) if x != y} <= {"women,", "men", "Gay"} and len(set(b.split()) & set(toxicity.IDENTITY_TERMS)) == 3
        else:
            assert b.endswith(a) and b.split()[0] in toxicity.IDENTITY_TERMS
    assert toxicity.sentences("one two. three four five! " + "six " * 200) == ["three four five", ("six " * 200).strip()]
    assert all(len(toxicity.named(s)) == 1 for s in toxicity.neutral_sentences())


def slow_score(model, text):
    """The sum over all weights, each looked for on its own."""
    words = set(re.findall(r"\w+", text.lower()))
    z = model.bias + sum(w for k, w in model.weights.items() if (any(x.startswith(k[:-1]) for x in words) if k.endswith("*") else k in words))
    return 1 / (1 + np.exp(-z))


def test_scores_against_brute_force(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.train(documents, labels.where(~toxicity.held_out()))
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    assert set(got) == set(texts) and all(abs(got[i] - slow_score(model, t)) < 1e-9 for i, t in texts.items())
    gaps = [abs(model.logit(a) - model.logit(b)) for a, b in toxicity.counterfactual_pairs(toxicity.neutral_sentences())]
    assert max(gaps) < 1.0


def test_repeated_ids_do_not_outgrow_the_sample(spark, frame, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_weights", lambda rows, *a, **k: seen.append(len(rows)) or (0.0, np.zeros(a[2])))
    d = frame([f"text number {i}" if i % 2 else "the same text" for i in range(3000)], [1] * 3000).union(frame([f"other {i}" for i in range(40)], range(10, 50)))
    labels = spark.createDataFrame([(i, i % 2) for i in [1, *range(10, 50)]], "doc_id long, toxic int")
    toxicity.train(d, labels, sample_rows=100)
    toxicity.train(d, labels, sample_rows=10_000)
    assert seen == [100, 1541]


def test_penalty_removes_the_bias_of_group_names():
    """Labels in which a group's name goes with toxicity by accident: the penalty takes its weight away, the insult keeps its own."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(400):
        bad = rng.random() < 0.5
        row = [0] if bad else []  # 0: an insult
        if rng.random() < (0.8 if bad else 0.1):
            row.append(1)  # 1: a group's name
        if not bad and rng.random() < 0.3:
            row.append(2)  # 2: another group's
        rows.append(np.array(row, np.int64))
        labels.append(bad)
    pairs = [(np.array([1]), np.array([2])), (np.array([], np.int64), np.array([1])), (np.array([], np.int64), np.array([2]))]
    _, free = toxicity.fit_weights(rows, np.array(labels), [], 3, rounds=300)
    _, fair = toxicity.fit_weights(rows, np.array(labels), pairs, 3, rounds=300)
    assert abs(fair[1] - fair[2]) < 0.2 * abs(free[1] - free[2]) and fair[0] > 2 and abs(fair[1]) < 0.3


def test_classifier(spark, frame):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(words, 30)) + (" you idiot scum" if i % 4 == 0 else "") for i in range(400)] + [None, "", "idiot scum " * 30_000, "women and muslims met the idiot scum", "women and muslims met"]
    d = frame(texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(d, labels).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for i, r in got.items() if r.held_out and i < 400]
    assert held and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert got[402].predicted == got[403].predicted == 1 and got[400].predicted == got[401].predicted == got[404].predicted == 0
    model = toxicity.train(d, labels.where(~toxicity.held_out()))
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.classify(d.where("false"), labels).count() == 0 and toxicity.classify(d, labels.where("false")).where("predicted = 0").count() == len(texts)


def test_labels_and_metadata_are_no_inputs(spark, frame):
    d = frame(["same text here", "same text here"], [1, 7])
    rows = toxicity.score(d.withColumn("lang", F.lit("en")).withColumn("source", F.col("doc_id").cast("string")), toxicity.Model(0.1, {"text": 1.0, "hea*": 3.0})).collect()
    assert rows[0].score == rows[1].score
