"""Toxicity scores of restored text: noisy-channel deobfuscation, then a presence classifier.

Three parts are learned:

* a character trigram model from the whole corpus (counts of every batch, summed by Spark),
* a lexicon of words and word beginnings that toxic documents hold much more often, with their
  log odds, from at most TRAIN_ROWS labelled rows outside the held-out quarter (a bounded sample
  by hash order) and at most LEXICON entries; the clearest first, others only where they explain
  toxic documents that hold none of those,
* the chance that a document without any of them is toxic.

A word that looks disguised (a digit or sign inside or before letters or in their place, a letter three
times in a row, letters of another script among Latin ones) is a noisy form of a plain word. Its lattice
holds for each character the letters it may stand for (any letter for one odd mark), or nothing where it
repeats or separates; Viterbi finds the likeliest letters under the trigram model mixed with the lexicon's
own. Three or more single characters spaced out are one run, whatever its length; each gap of it may be a
border of words or nothing, so a run may hold several words, plain or not, and a word of the lexicon may be
written at the cost of choosing it. A word of the lexicon that one space divides is found by its two parts,
unless both are words of clean texts. Every restored word is looked up like a plain one, and whole words
also within it; words joined by marks are also looked up one by one. Each distinct word or run of a batch
is handled once.

Cases: null and empty texts hold no word and score as such; rows without id are never held out;
repeated rows score alike; of repeated labels of an id the toxic one counts; without labels all
score zero; extra columns are ignored or kept by ``keep_clean``; an empty table gives no rows.
"""

import dataclasses
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm import arrays
from logwarden.llm.common import stage

TRAIN_ROWS = 20_000
LEXICON = 4_096
HELD_OUT = 2  # remainder of crc32(id) modulo 4
THRESHOLD = 0.3
BEGINNINGS = (4, 5)  # letters of word beginnings that are features beside whole words
LEAST_DOCS, LEAST_ODDS = 3, (5.0, 3.5, 1.5)  # lower bounds of log odds, round by round
MOST_LOGIT = 12.0
REMEMBERED, REMEMBERED_RUNS = 200_000, 2_000

# What characters stand for when they replace letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
        "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = set(".-_*~'’·")
# Letters of other scripts that look like Latin ones.
ALIKE = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i",
         "ѕ": "s", "ԁ": "d", "ј": "j", "ɡ": "g", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
WILD = set("#%^&=?×¤°§")  # marks that may hide any letter
JOINTS = re.compile(r"[/|\\,;:+&]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
WITHIN = 5  # letters of a word that is also found inside a decoded one
STRIPPED = "".join(map(chr, range(33, 48))) + ":;<=>?[\\]^_`{|}~¿«»“”…„"
LEET_COST, DROP_COST, REPEAT_COST, ALIKE_COST, WILD_COST = math.log(0.3), math.log(0.2), math.log(0.6), math.log(0.5), math.log(0.01)

# Trigram alphabet: 0 is a word's edge, 1 to 26 letters, 27 any other character.
EDGE, OTHER, SIZE = 0, 27, 28
_CLASS = np.full(256, OTHER, np.int64)
_CLASS[arrays.SPACE] = EDGE
_CLASS[ord("a"):ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_CLASS[[ord(c) for c in ".,;:!?\"()"]] = EDGE
_STRIPPED = np.zeros(256, bool)
_STRIPPED[[ord(c) for c in STRIPPED if ord(c) < 128]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def code(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else OTHER


@dataclasses.dataclass
class Model:
    """What the tasks need; its size is bounded by LEXICON and the trigram alphabet."""

    weights: dict[str, float]
    plain_logit: float  # of texts without any feature
    prior: float  # of texts with some, before their weights
    trigrams: np.ndarray  # log chances, by the two characters before
    fragments: dict[tuple[str, str], str] = dataclasses.field(default_factory=dict)  # words by two parts, one of which is no word

    def logit(self, word: str) -> tuple[str, float] | None:
        """The strongest feature of a word."""
        found = [(self.weights[f], f) for f in features(word) if f in self.weights]
        return (max(found)[1], max(found)[0]) if found else None


def features(word: str):
    yield word
    for n in BEGINNINGS:
        if len(word) > n:
            yield word[:n] + "+"


def plain(word: str) -> str:
    return word.lower().strip(STRIPPED)


def disguised(word: str) -> str | None:
    """The part of a word to decode, or None if it looks plain."""
    word = word.lower().rstrip(STRIPPED.replace("$", "").replace("!", "") + "!").lstrip("\"'([{<¿«“„*_-.,:;#%&=?/\\")
    if len(word) < 3:
        return None
    if not any("a" <= c <= "z" for c in word):  # signs for letters alone, but no number or sum of money
        return word if SIGNS.fullmatch(word) and not MONEY.fullmatch(word) else None
    if word.isalpha():
        mixed = any(c in ALIKE for c in word)
        return word if mixed or any(word[k] == word[k - 1] == word[k - 2] for k in range(2, len(word))) else None
    odd = [c for c in word if not c.isalpha()]
    hidden = sum(c in WILD for c in odd)
    known = all(c in LEET or c in SEPARATORS or c in WILD for c in odd)
    return word if known and (not hidden or hidden == 1 and len(word) > WITHIN - 1 and word[0] not in WILD and word[-1] not in WILD) else None


SIGNS = re.compile(r"[0-9]*[@$][0-9@$!|+(<]*[@$][0-9@$!|+(<]*|[@$][0-9@$!|+(<]{2,}|[0-9]+[@$][0-9@$!|+(<]+")
MONEY = re.compile(r"[$€£]*[0-9.,]+[$€£%!]*|[@$!|+(<]+")


class Lexicon:
    """Tree of the features' letters; node 0 is outside. All entries are equally likely."""

    def __init__(self, entries):
        self.next: list[dict[str, int]] = [{}]
        self.words, self.beginnings = set(), set()
        for entry in entries:
            node = 0
            for c in entry.removesuffix("+"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                node = self.next[node][c]
            (self.beginnings if entry.endswith("+") else self.words).add(node)
        self.cost = math.log(0.5 / max(1, len(self.words) + len(self.beginnings)))


NO_WORDS = Lexicon(())


def choices(char: str) -> list[tuple[float, str]]:
    """(cost, letter) of what a character may stand for."""
    if char in WILD:
        return [(WILD_COST, c) for c in LETTERS]
    found = [(LEET_COST, c) for c in LEET.get(char, "")]
    if char in ALIKE:
        found.append((ALIKE_COST, ALIKE[char]))
    if char.isalpha():
        found.append((0.0, char))
    return found


def decode(word: str, trigrams, lexicon: Lexicon = NO_WORDS) -> str:
    """The likeliest letters behind ``word``, where a space may be a border of words or nothing.

    A state is the two letters before and the place in the lexicon's tree. A restored word is
    written by the trigram model, or as an entry of the lexicon at the cost of choosing it; a
    beginning goes on by the model. Paths are chains of (letter, before), so a step costs the same
    however long the word is."""
    gapped = " " in word
    letters = [k for k, c in enumerate(word) if c != " "]
    stretched = set()  # of spaced letters only three alike are a stretch, as plain words have two
    for i, j, k in zip(letters, letters[1:], letters[2:]):
        if word[i] == word[j] == word[k]:
            stretched |= {j, k}
    best = {(EDGE, EDGE, 0): (0.0, None)}
    previous = ""
    for k, char in enumerate(word):
        following: dict = {}

        def reach(state, score, path):
            if state not in following or following[state][0] < score:
                following[state] = (score, path)

        if char == " ":
            for (a, b, node), (score, path) in best.items():
                reach((a, b, node), score, path)
                if path is None or path[0] == " ":
                    continue
                if not node:
                    reach((EDGE, EDGE, 0), score + trigrams[a][b][EDGE], (" ", path))
                elif node in lexicon.words:
                    reach((EDGE, EDGE, 0), score, (" ", path))
            best = following
            continue
        options = choices(char)
        nothing = None
        if char in SEPARATORS or (char in LEET and not char.isdigit()):
            nothing = DROP_COST
        if char == previous and (not gapped or k in stretched):
            nothing = REPEAT_COST
        previous = char
        for (a, b, node), (score, path) in best.items():
            if nothing is not None and path and path[0] != " ":
                reach((a, b, node), score + nothing, path)
            begins = not node and (path is None or path[0] == " ")
            for cost, letter in options:
                c = code(letter)
                if not node:
                    reach((b, c, 0), score + cost + trigrams[a][b][c], (letter, path))
                if (node or begins) and (to := lexicon.next[node].get(letter)):
                    new = score + cost + (lexicon.cost if begins else 0.0)
                    reach((b, c, to), new, (letter, path))
                    if to in lexicon.beginnings:
                        reach((b, c, 0), new, (letter, path))
        best = following or best
    ends = [(score + (0.0 if node else trigrams[a][b][EDGE]), path) for (a, b, node), (score, path) in best.items()
            if not node or node in lexicon.words]
    path = max(ends, key=lambda end: end[0])[1] if ends else None
    out = []
    while path:
        letter, path = path
        out.append(letter)
    return "".join(reversed(out))


def corpus_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts; each batch sends its sums."""
    def count(batches):
        for batch in arrays.pieces(batches):
            data, offsets = arrays.plain(batch.column("text"))
            if len(data) < 3:
                continue
            kind = _CLASS[data]
            number = np.bincount((kind[:-2] * SIZE + kind[1:-1]) * SIZE + kind[2:], minlength=SIZE ** 3)
            some = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(number[some].astype(np.int64))], ["code", "n"])

    counts = np.zeros(SIZE ** 3)
    for row in docs.select("text").mapInArrow(arrays.tidy(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[row["code"]] = row["n"]
    return counts.reshape(SIZE, SIZE, SIZE)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents (text, toxic) outside the held-out quarter."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "toxic")


def fragments(sample: DataFrame, weights: dict[str, float]) -> dict[tuple[str, str], str]:
    """Lexicon words by the two parts a space may leave, where not both parts are words of clean texts."""
    splits = {(word[:k], word[k:]): word for word in weights if len(word) >= WITHIN - 1 and not word.endswith("+") for k in range(1, len(word))}
    parts = {p for pair in splits for p in pair}

    def seen(batches):
        for batch in batches:
            held: Counter = Counter()
            for text in batch.column("text").to_pylist():
                held.update(parts & {plain(w) for w in (text or "").split()})
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["part", "n"])

    counted = sample.filter("toxic = 0").select("text").mapInArrow(arrays.tidy(seen), "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    words = {row["part"] for row in counted.filter(F.col("n") >= LEAST_DOCS).collect()}  # at most the parts of LEXICON entries
    return {pair: word for pair, word in splits.items() if not (pair[0] in words and pair[1] in words)}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = stage(training_rows(docs, labels), "training")

    def count(batches):
        for batch in batches:
            toxic, every = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                held = {f for w in set((text or "").split()) for f in features(plain(w)) if f}
                every.update(held)
                if label:
                    toxic.update(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(every), pa.string()), pa.array([toxic[f] for f in every], pa.int64()), pa.array(list(every.values()), pa.int64())],
                ["feature", "toxic", "n"])

    sizes = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    bad, good = sizes["toxic"], sizes["n"] - sizes["toxic"]
    prior = math.log((bad + 0.5) / (good + 0.5))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (good + 1))
    doubt = 1.96 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("n") - F.col("toxic") + 0.5))
    weights: dict[str, float] = {}
    flat = np.zeros((SIZE, SIZE, SIZE))
    for least in LEAST_ODDS:
        # clean texts, and toxic ones that nothing explains yet: chance companions of clear words stay out
        left = scored(sample, Model(weights, 0.0, prior, flat)).filter("hits = 0 or toxic = 0").select("text", "toxic")
        strong = (left.mapInArrow(arrays.tidy(count), "feature string, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
                  .filter(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") - doubt >= least)
                  .orderBy(F.desc(F.col("odds") * F.col("toxic")), "feature").limit(LEXICON - len(weights)).collect())
        weights |= {row["feature"]: float(row["odds"]) for row in strong}

    corpus = corpus_trigrams(docs)
    own = np.zeros((SIZE, SIZE, SIZE))
    for word, weight in weights.items():
        if not word.endswith("+"):
            line = [EDGE, EDGE, *map(code, word), EDGE]
            for a, b, c in zip(line, line[1:], line[2:]):
                own[a, b, c] += weight
    def chances(counts, k):
        return (counts + k) / (counts + k).sum(axis=2, keepdims=True)
    model = Model(weights, 0.0, prior, np.log(0.5 * chances(corpus, 1.0) + 0.5 * chances(own, 0.01)))

    model = dataclasses.replace(model, fragments=fragments(sample, weights))

    # what is left without any feature
    plain_rows = scored(sample, model).filter("hits = 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    chance = (plain_rows["toxic"] + 0.02) / (plain_rows["n"] + 1.0) if bad else 1e-9
    return dataclasses.replace(model, plain_logit=min(math.log(chance / (1 - chance)), prior))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``score`` and ``hits`` (different features found)."""
    names = [f.name for f in docs.schema]

    def every(batches):
        memory: dict[bytes, tuple[str, float] | None] = {}
        runs: dict[str, set[tuple[str, float]]] = {}
        lexicon, fast = Lexicon(model.weights), dataclasses.replace(model, trigrams=model.trigrams.tolist())
        first_parts, last_parts = {a for a, _ in model.fragments}, {b for _, b in model.fragments}
        for batch in arrays.pieces(batches):
            data, offsets = arrays.plain(batch.column("text"))
            starts, ends, first = arrays.words(data, offsets)
            logits, hits = np.full(batch.num_rows, model.plain_logit), np.zeros(batch.num_rows, np.int32)
            if len(starts):
                cuts = np.append(starts, len(data)).astype(np.int64)  # a word with the white space after it
                coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [
                    None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(memory) + len(distinct) > REMEMBERED:
                    memory.clear()
                found = []
                for word in distinct:
                    if word not in memory:
                        memory[word] = look_up(word.decode("utf-8", "replace").strip(), fast)
                    found.append(memory[word])
                spelled = spaced(data, starts, ends, first)
                marked = np.array([f is not None for f in found], bool)
                index = np.asarray(coded.indices)
                at = np.flatnonzero(marked[index])
                row = np.searchsorted(first, at, "right") - 1
                pairs = {(r, found[i]) for r, i in zip(row.tolist(), index[at].tolist())}
                if model.fragments:
                    shown = [plain(word.decode("utf-8", "replace").strip()) for word in distinct]
                    left = np.array([w in first_parts for w in shown], bool)[index]
                    right = np.array([w in last_parts for w in shown], bool)[index]
                    for n in np.flatnonzero(left[:-1] & right[1:]).tolist():
                        r = int(np.searchsorted(first, n, "right")) - 1
                        joined = model.fragments.get((shown[index[n]], shown[index[n + 1]]))
                        if joined and n + 1 < first[r + 1]:
                            pairs.add((r, model.logit(joined)))
                if len(runs) + len(spelled) > REMEMBERED_RUNS:
                    runs.clear()
                for r, run in spelled:
                    if run not in runs:
                        runs[run] = look_up_run(run, fast, lexicon)
                    pairs |= {(r, hit) for hit in runs[run]}
                for r, (_, weight) in pairs:
                    logits[r] = (logits[r] if hits[r] else model.prior) + weight
                    hits[r] += 1
            score = 1 / (1 + np.exp(-np.clip(logits, -30, MOST_LOGIT)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(hits)], [*names, "score", "hits"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(arrays.tidy(every), f"{kinds}, score double, hits int")


def look_up(word: str, model: Model) -> tuple[str, float] | None:
    """The strongest feature of a word as written, as decoded, inside what was decoded, or of its parts."""
    hit = model.logit(plain(word))
    if hit is None and (noisy := disguised(word)):
        clear = decode(noisy, model.trigrams)
        hit = model.logit(clear) or inside(clear, model)
    if hit is None and JOINTS.search(word):
        hits = [h for part in JOINTS.split(word) if part != word and (h := look_up(part, model))]
        hit = max(hits, key=lambda h: (h[1], h[0]), default=None)
    return hit


def inside(clear: str, model: Model) -> tuple[str, float] | None:
    """The strongest whole word of at least WITHIN letters within decoded letters."""
    longest = max(map(len, model.weights), default=0)
    found = {clear[a:b] for a in range(len(clear)) for b in range(a + WITHIN, min(len(clear), a + longest) + 1)}
    hits = [(model.weights[w], w) for w in found if w in model.weights]
    return (max(hits)[1], max(hits)[0]) if hits else None


def look_up_run(run: str, model: Model, lexicon: Lexicon) -> set[tuple[str, float]]:
    """Features of the words behind spaced characters: the run as one word, and as the words it is cut into."""
    found = {look_up(run.replace(" ", ""), model)}
    found |= {model.logit(plain(word)) for word in decode(run, model.trigrams, lexicon).split()}
    return found - {None}


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[tuple[int, str]]:
    """(row, characters) of three or more single characters in a row within a text, with a space
    between. Marks around a character do not count."""
    begun = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    marks = np.append(0, np.cumsum(_STRIPPED[data]))
    chars = begun[ends] - begun[starts]
    single = np.zeros(len(starts) + 2, np.int8)
    single[1:-1] = (chars == 1) | (chars - (marks[ends] - marks[starts]) == 1)
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    out = []
    begin, end = np.flatnonzero(np.diff(single) == 1), np.flatnonzero(np.diff(single) == -1)
    long = end - begin >= 3
    for a, b in zip(begin[long].tolist(), end[long].tolist()):
        edges = [a, *(np.flatnonzero(np.diff(row[a:b])) + a + 1).tolist(), b]
        for i, j in zip(edges, edges[1:]):
            if j - i >= 3:
                out.append((int(row[i]), " ".join(data[starts[i]:ends[j - 1]].tobytes().decode("utf-8", "replace").lower().split())))
    return out


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = model or fit(docs, labels)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, as they were."""
    model = model or fit(docs, labels)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") if c != "text" else F.col("text") for k, c in enumerate(docs.columns)])
    kept = scored(inner, model).filter(F.col("score") < THRESHOLD)
    return kept.select(*[F.col(f"c{k}").alias(c) if c != "text" else F.col("text") for k, c in enumerate(docs.columns)])
