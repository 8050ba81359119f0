import re

import corpus_pipeline
from folioscan.llm import exact_dedup, packing, toxicity
from folioscan.llm.common import load


def test_pipeline_matches_brute_force(spark, documents):
    sf = "/root/testdata/sf0.001"
    columns = documents.columns
    docs = documents
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), documents.schema)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    texts = {r.doc_id: r.text for r in documents.collect()}
    model = toxicity.train(documents, load(spark, sf, "labels").where(~toxicity.held_out()).select("doc_id", "toxic"))
    clean = {i: t for i, t in texts.items() if model.score(t) < 0.5}
    assert seen[0] == clean and 0 < len(clean) < len(texts)
    first = {}
    for i, t in sorted(clean.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), i)
    exact = {i: clean[i] for i in first.values()}
    assert seen[1] == exact
    ids, label = sorted(exact), {i: i for i in exact}
    sets = {}
    for i, t in exact.items():
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert seen[2] == {i: exact[i] for i in ids if label[i] == i}
    assert set(seen[3]) == set(seen[2])
    raw = {i: t.encode() for i, t in seen[2].items()}
    counts = {}
    for t in raw.values():
        for k in range(len(t) - 199):
            counts[t[k : k + 200]] = counts.get(t[k : k + 200], 0) + 1
    for i, t in raw.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if counts[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert seen[3][i] == bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
    out = corpus_pipeline.run(spark, sf).collect()
    want = packing.pack(docs, with_ids=True).collect()
    ids_of = lambda rows: {(r.doc_id, r.doc_tokens): sum(x.length for x in rows if x.doc_id == r.doc_id) for r in rows}
    assert ids_of(out) == ids_of(want) and {r.doc_id for r in out} == set(seen[3])


def test_registry():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in names if n == "pipeline"] and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names) and exact_dedup.SQL
