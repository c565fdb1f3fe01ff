"""Operators against their brute-force versions on messy rows, and on empty tables."""

import dataclasses
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from conftest import messy_docs, words
from pyspark.sql import functions as F

from logwarden.llm import (arrays, common, cover_dedup, graph, packing, quality, search, secrets, simhash, suffix_dedup, tokens, toxicity, warc)

ROWS = messy_docs()
JSON = tokens.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = tokens.ranks_tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def same(df, columns, expected):
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("length", [20, 100])
def test_suffix_dedup(docs, length):
    same(suffix_dedup.dedup(docs(ROWS), length), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.suffix_dedup(ROWS, length))


def test_suffix_dedup_crowded_seed_and_small_pieces(docs, monkeypatch):
    rng = random.Random(3)
    line = words(rng, 25)
    rows = [(k, words(rng, 9) + line + words(rng, 9)) for k in range(40)]
    monkeypatch.setattr(suffix_dedup.repeats.to_open, "__defaults__", (3,))
    same(suffix_dedup.dedup(docs(rows), 60), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.suffix_dedup(rows, 60))


def test_texts_of_one_id_are_told_apart(docs, monkeypatch):
    """Many texts without id, two of them with one crc32; also where keys of texts clash at first."""
    rng = random.Random(4)
    seen = {}
    while True:
        text = "".join(rng.choices("abcdefgh", k=12))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            break
    low = words(rng, 60)
    rows = [(None, text + low), (None, other + low[:40]), (None, low + other), (5, low), (5, text + low), (None, text)]
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    same(suffix_dedup.dedup(docs(rows), 60), columns, brute.suffix_dedup(rows, 60))
    strong = common.text_key
    monkeypatch.setattr(common, "text_key", lambda salt: F.lit(7).cast("long") if salt in (0, 1) else strong(salt))
    assert common.salt_for(docs(rows)) == 2 and common.salt_for(docs(rows[3:4])) == 0
    same(suffix_dedup.dedup(docs(rows), 60), columns, brute.suffix_dedup(rows, 60))
    same(cover_dedup.dedup(docs(rows), 5), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.substring_dedup(rows, 5))


@pytest.mark.parametrize("window", [3, 10, 35])
def test_substring_dedup(docs, window):
    same(cover_dedup.dedup(docs(ROWS), window), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.substring_dedup(ROWS, window))


def test_covers_hold():
    for period, cover in cover_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_simhash(docs):
    found = simhash.groups(docs(ROWS), 4, 4).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), "component_id")
    same(found, ["doc_id", "fp", "component_id"], brute.simhash(ROWS))


@pytest.mark.parametrize("home_rows, wide", [(2, 1 << 26), (65_536, 1 << 26), (65_536, 0)])
def test_simhash_links_lose_none(spark, monkeypatch, home_rows, wide):
    monkeypatch.setattr(simhash, "WIDE", wide)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centres for _ in range(12)})
    monkeypatch.setattr(simhash, "HOME_ROWS", home_rows)
    given = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps], "fp long").repartition(3)
    found = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in graph.components(simhash.links(given, 4)).collect()}
    parts = {fp: {fp} for fp in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4 and parts[a] is not parts[b]:
                parts[a] |= parts[b]
                for x in parts[b]:
                    parts[x] = parts[a]
    for a in fps:
        assert {b for b in fps if found.get(b, b) == found.get(a, a)} == parts[a]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(links).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_quality_base(docs):
    same(quality.judge(docs(ROWS)), ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
         brute.quality(ROWS))


def test_quality_verdict(docs):
    rng = random.Random(9)
    plain = [(k, " ".join(rng.choice(["the", "of", "and", "to", "in", words(rng, 1)]) for _ in range(200))) for k in range(60)]
    odd = [(100, " ".join(f"{rng.getrandbits(40):X}#" for _ in range(200))), (101, " ".join(words(rng, 1, 9000) + "!" for _ in range(200)))]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs(plain + odd).withColumn("lang", F.lit("en"))).collect()}
    assert all(kept[k] for k, _ in plain) and not kept[100] and not kept[101]


def test_distance_is_jensen_shannon(spark):
    p, q = np.array([3.0, 1.0, 0.0]), np.array([1.0, 0.0, 1.0])
    a, b = p / p.sum(), q / q.sum()
    m = (a + b) / 2
    expected = np.sqrt(sum(x * np.log2(x / y) for u in (a, b) for x, y in zip(u, m) if x) / 2)
    df = spark.createDataFrame([(p.tolist(), q.tolist(), [0.0, 0.0])], "p array<double>, q array<double>, z array<double>")
    row = df.select(quality.distance(F.col("p"), F.col("q")).alias("d"), quality.distance(F.col("p"), F.col("z")).alias("none")).first()
    assert row["d"] == pytest.approx(expected) and row["none"] is None


def test_secrets(docs):
    found = secrets.scan(docs(ROWS))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    same(found.select("doc_id", *[secrets.count(F.col("spans"), k).alias(k) for k in secrets.BASE],
                      F.sha2(secrets.listed(base).cast("binary"), 256).alias("sha")), ["doc_id", "assign", "access", "hex", "sha"], brute.secrets(ROWS))


def test_secret_ledger_scans_only_what_is_new(spark, docs):
    ledger = secrets.new_ledger(spark)
    secrets.scan_new(docs(ROWS[:20]), ledger)
    one = secrets.read_ledger(spark, ledger).count()
    secrets.scan_new(docs(ROWS[:20]), ledger)
    assert secrets.read_ledger(spark, ledger).count() == one == len({t or "" for _, t in ROWS[:20]}) * len(secrets.RULES)
    changed = (*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]{30,}"))
    found = secrets.scan(docs(ROWS), ledger, changed)
    assert found.count() == len(ROWS)
    pairs = secrets.read_ledger(spark, ledger)
    assert pairs.count() == pairs.dropDuplicates(["blob", "version"]).count()


def test_kinds_and_order_are_those_of_the_rules_now(spark, docs):
    """Spans of every kind at known places; renamed and reordered rules need no new scan."""
    jwt = "eyJ" + "a" * 8 + ".eyJ" + "b" * 9 + ".c-_"
    text = f"é ghp_{'A' * 36} xoxb-{'1' * 10} {jwt} AKIA{'B' * 16} token: {'f' * 24} -----BEGIN RSA PRIVATE KEY-----\nQUJD\n-----END RSA PRIVATE KEY-----"
    ledger = secrets.new_ledger(spark)
    spans = secrets.scan(docs([(1, text)]), ledger).select(secrets.listed(F.col("spans")).alias("s")).first()["s"]
    at = {kind: text.index(start) for kind, start in (("github", "ghp_"), ("slack", "xoxb"), ("jwt", "eyJ"), ("access", "AKIA"), ("assign", "token"), ("hex", "f" * 24), ("pem", "-----B"))}
    size = {"github": 40, "slack": 15, "jwt": len(jwt), "access": 20, "assign": 31, "hex": 24, "pem": len(text) - at["pem"]}
    assert spans == ",".join(f"{k}:{at[k]}:{at[k] + size[k]}" for k in sorted(at, key=at.get))
    before = secrets.read_ledger(spark, ledger).count()
    renamed = tuple(dataclasses.replace(r, kind=r.kind.upper()) for r in reversed(secrets.RULES))
    again = secrets.scan(docs([(1, text)]), ledger, renamed).select("spans").first()["spans"]
    assert secrets.read_ledger(spark, ledger).count() == before
    assert [(s["kind"], s["rank"]) for s in again] == [(k.upper(), [r.kind for r in renamed].index(k.upper())) for k in sorted(at, key=at.get)]


def test_redact(docs):
    text = "é token = abcdefgh. ghp_" + "a" * 36 + " end"
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs([(1, text), (2, None), (3, "clean"), (4, "password=" + "a" * 30)])).collect()}
    assert out == {1: "é [secret] [secret] end", 2: None, 3: "clean", 4: "[secret]"}


PAGES = [(1, "http://B.org/x", "p" * 200), (2, None, None), (3, "https://a.org/y z\n", "p" * 200), (4, "http://b.org/x", "é" * 50), (5, "u", "é" * 50),
         (6, "u", "short"), (7, "u", "short"), (None, "n", "p" * 200), (None, "n", "q" * 150), (None, "n", "q" * 150), (1, "http://B.org/x", "p" * 200),
         (8, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 9), (9, "v", ""), (-3, "w", "r" * 100), (10, "w", "r" * 100)]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int")
    found = warc.archive(pages)
    expected = [(i, n, d, *(("response", None) if k is None else (r, k))) for i, n, d, r, k in brute.warc([(i, h) for i, _, h in PAGES])]
    same(found, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], expected)
    rows = [(r["url_key"], r["ts"], warc.LOWEST if r["page_id"] is None else r["page_id"]) for r in found.orderBy("range", "place").collect()]
    assert rows == sorted(rows)
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


def test_loser_tree():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted((rng.randrange(20), 0) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


@pytest.mark.parametrize("travelling", [20_000, 0])
def test_search(spark, monkeypatch, travelling):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(300)] + [(400 + k, [0.5] * 6) for k in range(60)]
    rows += [(None, [1.0] * 6), (500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (550, [float("inf")] * 6), (600, [0.25] * 6),
             (600, [0.25] * 6), (601, [3.0, 1.0])]
    monkeypatch.setattr(search, "LEAF_ROWS", 32)
    monkeypatch.setattr(search, "PART_GROUPS", 3)
    monkeypatch.setattr(search, "TRAVELLING", travelling)
    given = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, node int")
    padded = [(i, v if not v or len(v) == 6 else [*v, 0.0, 0.0, 0.0, 0.0]) for i, v in rows]
    same(search.top(given, 50, 5), ["query_id", "rank", "vec_id", "score"], brute.top_k(padded))


def test_search_prunes_clusters(spark, monkeypatch):
    """Clusters apart from each other: a group of queries visits few leaves, and the rows stay exact."""
    rng = np.random.default_rng(6)
    centres = 40 * np.eye(40)
    rows = [(k, (centres[k % 40] + rng.normal(size=40) / 4).tolist()) for k in range(4000)]
    monkeypatch.setattr(search, "LEAF_ROWS", 40)
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    vectors = search.stage(search.integers(given), "vectors")
    placed, nodes = search.tree(vectors, 40)
    assert nodes.select("parent").distinct().count() > 10 and nodes.agg(F.max("node")).first()[0] > 16 ** 2
    lowest = nodes.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    held = search.stage(search.leaves(placed, lowest, 50, 5, 40), "leaves")
    groups, leaves = held.filter(F.length("query_ids") > 0).count(), held.count()
    assert held.agg(F.max(F.length("ids"))).first()[0] <= 8 * 80 and search.visits_of(held, nodes).count() < groups * leaves / 10
    same(search.top(given), ["query_id", "rank", "vec_id", "score"], brute.top_k(rows))


def test_search_with_few_rows(spark):
    given = spark.createDataFrame([(0, [1.0]), (3, [2.0]), (50, [-1.0])], "vec_id long, embedding array<float>")
    same(search.top(given), ["query_id", "rank", "vec_id", "score"], brute.top_k([(0, [1.0]), (3, [2.0]), (50, [-1.0])]))


def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def test_tokens_round_trip(docs):
    other = tik()
    decoded = {(r["doc_id"], bytes(r["decoded"])): np.frombuffer(r["ids"], "<u4").tolist()
               for r in tokens.decode(tokens.encode(docs(ROWS), RANKS), RANKS).collect()}
    assert decoded == {(i, (t or "").encode()): other.encode_ordinary(t or "") for i, t in ROWS}


def test_token_offsets_and_split_characters(docs):
    text = "naïve 🙂🙂 çé"
    row = tokens.encode(docs([(1, ""), (2, text), (3, "x")]), JSON, with_offsets=True).filter("doc_id = 2").first()
    ids, starts = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["starts"], "<u8").tolist()
    decoder = tokens.Decoder(JSON())
    assert decoder.text(ids) == text and starts == decoder.bytes(ids)[1][:-1].tolist()
    assert "�" in "".join(decoder.text([i]) for i in ids) and b"".join(decoder.bytes(np.array([i]))[0].tobytes() for i in ids) == text.encode()
    with pytest.raises(ValueError):
        decoder.bytes(np.array([60_000]))


@pytest.mark.parametrize("seed", range(3))
def test_parts_do_not_change_ids(seed):
    rng = random.Random(seed)
    other = tik()
    encoder = tokens.Encoder(RANKS())
    for _ in range(150):
        text = "".join(rng.choice(["a", "É", " ", "  ", "\n", "\t", " ", " ", "　", "\x85", "1", "'s", "!", "日", "-", "Ab", " b"]) for _ in range(40))
        for e in (encoder, tokens.Encoder(JSON())) if rng.random() < 0.1 else (encoder,):
            import pyarrow as pa
            assert e.batch(pa.array([text, None, text]))[0].tolist() == 2 * other.encode_ordinary(text)


SPECIAL = [(80, "<|endoftext|>"), (81, "a <|endoftext|> b"), (82, "x<|endoftext|>y  <|endoftext|><|endoftext|>"), (83, "<|endof<|endoftext|>text|>"),
           (84, "<|endoftext|>" * 200), (85, "don't<|endoftext|>'t <|endoftext| > |>")]


def test_packing(docs):
    """Ids as the library gives them from the file, strings of its special token included."""
    library, given = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ROWS + SPECIAL
    assert 50256 in library.encode("a <|endoftext|> b", add_special_tokens=False).ids
    pieces = tokens.cut_pieces(docs(given), JSON, 2, 128, with_ids=True)
    packed = packing.pack(pieces, 128)
    rows = packed.collect()
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        ends = [0, *[o + n for o, n in sorted(places)]]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 128
    total = sum(r["length"] for r in rows)
    assert len(held) <= -(-total // 128) * 1.1 + 1
    expected = []
    for i, t in given:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 128 + 1
        cuts = [0, *range(first, len(ids) + 1, 128)]
        expected += [(i, n, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    same(packed.withColumn("ids", F.hex("ids")), ["doc_id", "piece", "start", "length", "ids"], [(*e[:4], e[4].hex().upper()) for e in expected])
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(packed).collect()}
    assert whole == {s: sum(n for _, n in places) for s, places in held.items()}


@pytest.mark.parametrize("seed", range(5))
def test_fullest_is_the_best_sum(seed):
    rng = random.Random(seed)
    left = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(6)}
    room = rng.randrange(5, 60)
    sums = {0}
    for length, n in left.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    chosen = packing.fullest(left, room)
    assert sum(chosen) == max(s for s in sums if s <= room) and all(chosen.count(x) <= left[x] for x in chosen)


BAD = ["gronk", "blarg", "zwiebl"]


def toxic_table(spark, docs):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        toxic = int(k % 5 == 0)
        text = words(rng, 60).split()
        if toxic:
            text.insert(rng.randrange(60), rng.choice(BAD))
        rows.append((k, " ".join(text)))
        labels.append((k, toxic))
    return rows, spark.createDataFrame([*labels, (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")


def test_toxicity(spark, docs):
    rows, labels = toxic_table(spark, docs)
    extra = [(None, None), (1001, ""), (1002, "you g r o n k here"), (1003, "such a bl4rg!"), (1004, "gronnnnk"), (1005, "g.r.o.n.k!!"), (1006, "Zwiebl.")]
    found = {r["doc_id"]: r for r in toxicity.score(docs(rows + extra), labels).collect()}
    assert len(found) == len(rows) + len(extra)
    held = [(found[k]["predicted"], int(k % 5 == 0)) for k, _ in rows if found[k]["held_out"]]
    assert len(held) > 50 and all(p == t for p, t in held)
    assert {k: found[k]["predicted"] for k in (None, 1001, 1002, 1003, 1004, 1005, 1006)} == {
        None: 0, 1001: 0, 1002: 1, 1003: 1, 1004: 1, 1005: 1, 1006: 1}
    kept = toxicity.keep_clean(docs(rows), labels)
    assert kept.columns == docs(rows).columns and {r["doc_id"] for r in kept.collect()} == {k for k, _ in rows if k % 5}


def test_toxicity_of_disguises(spark, docs):
    """Gaps within a word, joints, marks for letters, letters of other scripts, letters around; and plain look-alikes of these."""
    rows, labels = toxic_table(spark, docs)
    model = toxicity.fit(docs(rows), labels)
    bad = ["you gr onk now", "a gro nk", "x gr0nk/blarg y", "this gr#nk here", "a grоnk", "xxgr0nkxx", "blarg,zwiebl", "z w i e b l", "a bl a rg b l a r g"]
    good = ["grand onkel", "$100 and 1,000 or 50%", "a/b and/or c", "#1 #tag ### $$$ @@", "gro wth nk", "1984", "grow onk", "е-mail о", "100$ 3.50$ @5"]
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs([(2000 + n, t) for n, t in enumerate(bad + good)]), labels, model).collect()}
    assert {n: found[2000 + n] for n in range(len(bad + good))} == {n: int(n < len(bad)) for n in range(len(bad + good))}


@pytest.mark.parametrize("seed", range(4))
def test_decoding_is_the_best_path(seed):
    """Short words against every path of letters, drops and repetitions."""
    rng, chances = random.Random(seed), np.random.default_rng(seed)
    trigrams = np.log(chances.dirichlet(np.full(toxicity.SIZE, 0.3), (toxicity.SIZE, toxicity.SIZE)) + 1e-9).tolist()

    def value(letters, cost):
        line = [toxicity.EDGE, toxicity.EDGE, *map(toxicity.code, letters), toxicity.EDGE]
        return cost + sum(trigrams[a][b][c] for a, b, c in zip(line, line[1:], line[2:]))

    for _ in range(60):
        word = "".join(rng.choice("abno01@$!.-*#о") for _ in range(rng.randrange(1, 6)))
        paths = [("", 0.0)]
        for k, char in enumerate(word):
            nothing = toxicity.DROP_COST if char in toxicity.SEPARATORS or (char in toxicity.LEET and not char.isdigit()) else None
            if k and word[k - 1] == char:
                nothing = toxicity.REPEAT_COST
            more = [(letters + c, cost + own) for letters, cost in paths for own, c in toxicity.choices(char)]
            more += [(letters, cost + nothing) for letters, cost in paths if nothing is not None and letters]
            paths = more or paths
        best = max(value(*path) for path in paths)
        found = toxicity.decode(word, trigrams)
        assert max(value(*path) for path in paths if path[0] == found) == pytest.approx(best)


def test_scores_follow_from_the_weights(docs):
    model = toxicity.Model({"gronk": 4.0, "blar+": 2.0, "zwiebl": 3.0}, -5.0, -1.5, np.zeros((toxicity.SIZE,) * 3), {("zwi", "ebl"): "zwiebl"})
    rows = [(1, "gronk, Gronk! other"), (2, "blarg blarp gronk"), (3, "nothing"), (4, "zwi ebl"), (5, "zwi xx ebl"), (6, "gronk zwi\nebl")]
    sums = {1: -1.5 + 4, 2: -1.5 + 2 + 4, 3: -5.0, 4: -1.5 + 3, 5: -5.0, 6: -1.5 + 4 + 3}
    found = {r["doc_id"]: r["score"] for r in toxicity.scored(docs(rows).select("doc_id", "text"), model).collect()}
    assert found == {k: pytest.approx(1 / (1 + np.exp(-v))) for k, v in sums.items()}


def test_empty_tables(spark, docs):
    empty = docs(ROWS[:1]).filter("doc_id is null")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (suffix_dedup.dedup(empty), cover_dedup.dedup(empty), simhash.groups(empty), quality.judge(empty), secrets.scan(empty),
               toxicity.score(empty, labels), toxicity.keep_clean(empty, labels), tokens.decode(tokens.encode(empty, JSON), JSON),
               packing.pack(tokens.cut_pieces(empty, JSON, 2, 1024)), warc.archive(pages), search.top(vectors), secrets.redact(empty)):
        assert df.count() == 0


def test_pieces_keep_rows():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c" * 5]})
    cut = list(arrays.pieces(iter([batch]), limit=12))
    assert [r for b in cut for r in b.column("text").to_pylist()] == batch.column("text").to_pylist() and len(cut) > 2


def test_toxicity_in_spaced_runs_and_long_words(spark, docs):
    rows, labels = toxic_table(spark, docs)
    clean = " ".join("the rain is here and more rain is to come so stay in or take a coat and a hat".replace(" ", ""))
    extra = [(2001, "you are a g r o n k"), (2002, "I g r o n k"), (2003, "s o g r o n k b l a r g."), (2004, clean + " b l a r g " + clean),
             (2005, "gr" + "o" * 50 + "nk"), (2006, clean), (2007, "b l a r g! end"), (2008, "z w i i i i e b l")]
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(rows + extra), labels).collect() if r["doc_id"] > 2000}
    assert found == {2001: 1, 2002: 1, 2003: 1, 2004: 1, 2005: 1, 2006: 0, 2007: 1, 2008: 1}


def test_quality_references_of_small_and_no_languages(docs):
    rng = random.Random(10)
    plain = [(k, " ".join(rng.choice(["the", "of", "and", "to", "in", words(rng, 1)]) for _ in range(200)), "en") for k in range(60)]
    wide = [(100 + k, " ".join("".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(7)) for _ in range(120)), "zh") for k in range(3)]
    junk = [(200 + k, " ".join(f"{rng.getrandbits(40):X}#" for _ in range(200)), None) for k in range(3)]
    given = docs([]).sparkSession.createDataFrame(plain + wide + junk + [(300, plain[0][1], None)], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(given).collect()}
    assert kept == {k: True for k, *_ in plain + wide} | {k: False for k, *_ in junk} | {300: True}


def test_quality_takes_a_document_out_of_its_own_reference(docs):
    """Junk that is alone in its language is not its own measure; distances equal those computed by hand."""
    rng = random.Random(13)
    plain = [(k, " ".join(rng.choice(["the", "of", "and", "to", "in", words(rng, 1)]) for _ in range(200)), "en") for k in range(8)]
    junk = [(20, " ".join(f"{rng.getrandbits(40):X}#" for _ in range(200)), "xx"), (21, plain[0][1], "yy"), (22, plain[1][1], "zz"), (23, plain[2][1], "zz")]
    given = docs([]).sparkSession.createDataFrame(plain + junk, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in quality.judge(given).collect()}
    assert [k for k, r in found.items() if not r["kept"]] == [20] and found[20]["char_distance"] > 0.5
    assert found[21]["word_distance"] is None and found[22]["word_distance"] is None and found[0]["word_distance"] is not None

    def classes(text):
        kinds = ["digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "blank" if c.isspace() else "symbol" for c in text]
        return np.array([kinds.count(k) for k in ("lower", "upper", "digit", "symbol", "blank")], float)

    own = {k: classes(t) for k, t, _ in plain + junk}
    shares = lambda x: x / x.sum()
    for k, same_language in ((0, [n for n in range(1, 8)]), (22, [23]), (20, [])):
        rest = shares(sum(v for n, v in own.items() if n != k))
        weight = min(len(same_language), 2) / 2
        q = weight * shares(sum(own[n] for n in same_language)) + (1 - weight) * rest if same_language else rest
        p, m = shares(own[k]), (shares(own[k]) + q) / 2
        expected = np.sqrt(sum(x * np.log2(x / y) for u in (p, q) for x, y in zip(u, m) if x) / 2)
        assert found[k]["char_distance"] == pytest.approx(expected, abs=1e-9)


def test_redact_whole_private_keys(docs):
    rng = random.Random(12)
    def body(lines, end="\n"):
        return end.join("".join(rng.choice("abcdXYZ019+/") for _ in range(64)) for _ in range(lines))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    rows = [(1, f"a {begin}\n{body(25)}\nab+/==\n{end} b"), (2, f"a {begin}\n{body(25)}\nabc=\nAnd so on."), (3, f"a {begin}\\n{body(3, chr(92) + 'n')}\\n{end}\\n b"),
            (4, f"a {begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F\n\n{body(4)}\n{end}\n{begin}\n{body(2)}\n{end}"), (5, f"a {begin} {body(9, ' ')} {end} b"),
            (6, f"a {begin}\n{body(20000)}\n{end} b"), (7, f"a {begin}\n{body(20000)}"), (8, f"a {begin} is how a key begins"),
            (9, f"a {begin}\n{body(2)}\n-----BEGIN CERTIFICATE-----")]
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs(rows)).collect()}
    assert out == {1: "a [secret] b", 2: "a [secret]\nAnd so on.", 3: "a [secret]\\n b", 4: "a [secret]\n[secret]", 5: "a [secret] b", 6: "a [secret] b",
                   7: "a [secret]", 8: "a [secret] is how a key begins", 9: "a [secret]\n-----BEGIN CERTIFICATE-----"}
