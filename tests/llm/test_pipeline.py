"""Stages of the pipeline against plain versions, on a table with nulls, copies, secrets and clashing columns."""

import random
import re

import brute
import corpus_pipeline
import pytest
from conftest import messy_docs, words

BAD = ["gronk", "blarg"]
CALLS = {"toxicity": "toxicity", "simhash_near_dedup": "simhash", "suffix_array_dedup": "suffix", "secret_scans": "secret", "best_fit_packing": "pack"}


def cut(rows, length=100):
    """Texts without bytes that start earlier; broken characters go."""
    first, out = {}, []
    data = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for s in range(len(t) - length + 1):
            first[t[s:s + length]] = min((i, s), first.get(t[s:s + length], (i, s)))
    for (own, text), (i, t) in zip(rows, data):
        gone = set()
        for s in range(len(t) - length + 1):
            if first[t[s:s + length]] < (i, s):
                gone.update(range(s, s + length))
        left = bytes(b for k, b in enumerate(t) if k not in gone).decode("utf-8", "ignore")
        out.append((own, None if text is None else left))
    return out


def masked(text):
    if text is None:
        return None
    rules = [(r.pattern, r.group, r.least) for r in corpus_pipeline.secrets.RULES]
    gone = set()
    for pattern, group, least in rules:
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                gone.update(range(*m.span()))
    spans = sorted((m.span() for p, g, n in rules for m in re.finditer(p, text) if len(m[g]) >= n))
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture
def table(spark, docs, tmp_path):
    rng = random.Random(11)
    rows = messy_docs()
    rows += [(1000 + k, words(rng, 50) + (" " + rng.choice(BAD) + " " + words(rng, 5) if k % 5 == 0 else "")) for k in range(200)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows, str(tmp_path)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def alike(found, expected):
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_stages(spark, table):
    rows, folder = table
    assert [name for name, _ in corpus_pipeline.STAGES] == list(CALLS)
    docs = spark.read.parquet(folder + "/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, folder)
    given = [r for r in rows if not set(BAD) & set((r[1] or "").split())]
    assert clean.columns == columns
    alike(rows_of(clean), given)

    single = stages["simhash_near_dedup"](spark, clean, folder)
    found = rows_of(single)
    group = {row: root for row, (_, _, root) in zip(given, brute.simhash_groups(given))}
    assert single.columns == columns and len(found) == len({group[row] for row in found}) == len(set(group.values()))
    for i, text in found:  # the smallest id of its group, null only where the group has no id
        ids = [own for (own, t), g in group.items() if g == group[i, text] and own is not None]
        assert i == (min(ids) if ids else None)

    short = stages["suffix_array_dedup"](spark, single, folder)
    assert short.columns == columns
    alike(rows_of(short), cut(found))
    assert short.filter("n_chars <> length(text)").count() == 0

    hidden = stages["secret_scans"](spark, short, folder)
    assert hidden.columns == columns
    alike(rows_of(hidden), [(i, masked(t)) for i, t in rows_of(short)])
    assert hidden.filter("n_chars <> length(text)").count() == 0

    packed = stages["best_fit_packing"](spark, hidden, folder).collect()
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and sum(1 for r in packed if r["piece"] == 0) == hidden.count()


def test_run_gives_the_last_stage(spark, table):
    _, folder = table
    assert set(corpus_pipeline.run(spark, folder).columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_empty_documents(spark, docs, tmp_path):
    docs([(1, "x")]).filter("doc_id = 2").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
