"""Byte-level BPE over Arrow batches with the tokenizers library.

A batch is one buffer of bytes. It is cut where the split pattern always begins a new match: at a
single space between two characters that are no white space, and between a letter and an ASCII
mark. So the ids of a text are the ids of its parts in order. Equal parts are found by Arrow's
dictionary encoding and each is encoded once; a bounded memory of parts serves later batches.

A part that is one match (letters or marks, with one space before at most) is written in the
printable characters of its bytes and given to the library's BPE model; any other part goes
through the whole tokenizer. Decoding reverses the byte table, so a character that was split over
tokens comes back whole when its tokens stand together. Offsets are bytes of the text: tokens
follow each other without gaps.

Cases: null and empty texts have no ids; a string of an added token is that token, as the library
has it by default (rank files have none, so there it is ordinary text); repeated rows
are rows of their own; extra columns are ignored; an empty table gives no rows.
"""

import array
import base64
import functools
import json
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm import arrays

REMEMBERED, REMEMBERED_IDS = 150_000, 1_500_000  # parts and their ids kept by a task for later batches
MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def byte_table() -> list[str]:
    """Printable character of each byte: itself where printable, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


@functools.cache
def _byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_table())}


def from_json(path: str) -> tokenizers.Tokenizer:
    """Tokenizer of a file of the library's own format; its added tokens are tokens in texts too."""
    arrays.own_threads()
    return tokenizers.Tokenizer.from_file(path)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def from_ranks(path: str, pattern: str) -> tokenizers.Tokenizer:
    """Tokenizer of a rank file: every split of a token into two known tokens is a merge, in the
    order of the merged token, so the lowest-ranked neighbours merge first as with the ranks."""
    arrays.own_threads()
    ranks, shown = read_ranks(path), byte_table()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [(name[token[:k]], name[token[k:]])
              for token in sorted(ranks, key=ranks.get) for k in range(1, len(token))
              if token[:k] in ranks and token[k:] in ranks]
    model = tokenizers.models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, fuse_unk=False)
    found = tokenizers.Tokenizer(model)
    found.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([
        tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "isolated"),
        tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    found.decoder = tokenizers.decoders.ByteLevel()
    return found


@functools.cache
def _json_tokenizer(path: str) -> tokenizers.Tokenizer:
    return from_json(path)


@functools.cache
def _ranks_tokenizer(path: str, pattern: str) -> tokenizers.Tokenizer:
    return from_ranks(path, pattern)


def json_tokenizer(path: str) -> Callable[[], tokenizers.Tokenizer]:
    """For tasks: the tokenizer of a worker, made once."""
    return functools.partial(_json_tokenizer, path)


def ranks_tokenizer(path: str, pattern: str) -> Callable[[], tokenizers.Tokenizer]:
    return functools.partial(_ranks_tokenizer, path, pattern)


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_MARK[[ord(c) for c in MARKS if c != "'"]] = True


def parts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets at which the texts may be cut without changing their ids (ends included)."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        control = data <= 32
        odd = np.zeros(n, bool)  # white space beyond ASCII, begun (led) or ended here, rather too often
        lead = (data >= 0xE1) & (data <= 0xE3) | (data == 0xC2)
        odd[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        ended = np.zeros(n, bool)
        ended[1:] |= odd[:-1]
        ended[2:] |= lead[:-2] & (data[:-2] != 0xC2) & (data[1:-1] >= 0x80)
        cut[1:n - 1] = (data[1:-1] == 32) & ~control[:-2] & ~ended[:-2] & ~control[2:] & ~lead[2:]
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # À to ÿ without × and ÷
        cut[1:n] |= letter[:-1] & _MARK[data[1:]]
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of parts, kept between the batches of a task."""

    def __init__(self, tokenizer: tokenizers.Tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(byte_table())})
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = array.array("I"), array.array("q", [0])

    def _encode(self, part: bytes) -> list[int]:
        text = part.decode()
        match = text[1:] if text[:1] == " " else text
        if (match.isalpha() or (match and MARKS.issuperset(match))) and not any(a in text for a in self.added):
            return [token.id for token in self.model.tokenize(part.decode("latin-1").translate(self.shown))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def outside_added(self, data: np.ndarray, cuts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The cuts that do not fall inside an added token's text."""
        if not self.added:
            return cuts
        whole, inside = data.tobytes(), np.zeros(len(data) + 1, bool)
        for token in map(str.encode, self.added):
            at = whole.find(token)
            while at >= 0:
                inside[at + 1:at + len(token)] = True
                at = whole.find(token, at + 1)
        inside[offsets] = False  # a text ends there in any case
        return cuts[~inside[cuts]]

    def parts(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All kept ids, and where those of each part begin and end."""
        known = self.known
        if len(known) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            known.clear()
            self.ids, self.ends = array.array("I"), array.array("q", [0])
        index = []
        for part in some:
            k = known.get(part)
            if k is None:
                k = known[part] = len(self.ends) - 1
                self.ids.extend(self._encode(part))
                self.ends.append(len(self.ids))
            index.append(k)
        at, ends = np.array(index, np.int64), np.array(self.ends)
        return np.array(self.ids, np.uint32), ends[at], ends[at + 1]

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column in order, and the offsets of its rows."""
        data, offsets = arrays.plain(column)
        cuts = self.outside_added(data, parts(data, offsets), offsets)
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [
            None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        flat, first, end = self.parts(coded.dictionary.to_pylist())
        index = np.asarray(coded.indices)
        many = (end - first)[index]
        total = np.cumsum(many)
        ids = flat[np.repeat(first[index] - (total - many), many) + np.arange(total[-1])]
        return ids, np.append(0, total)[np.searchsorted(cuts, offsets)]


def encode(docs: DataFrame, tokenizer: Callable[[], tokenizers.Tokenizer], with_offsets: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and, if asked for, the first byte of
    each token in the text's UTF-8 (little-endian unsigned 64-bit)."""
    def every(batches):
        encoder = Encoder(tokenizer())
        lengths = Decoder(encoder.tokenizer).size if with_offsets else None
        for batch in arrays.pieces(batches):
            ids, rows = encoder.batch(batch.column("text"))
            columns = [batch.column("doc_id"), pa.array(np.diff(rows)), arrays.packed(ids.astype("<u4"), rows)]
            if with_offsets:
                starts = np.append(0, np.cumsum(lengths[ids]))[:-1]
                starts = starts - np.repeat(np.append(starts, 0)[rows[:-1]], np.diff(rows))
                columns.append(arrays.packed(starts.astype("<u8"), rows))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids"] + ["starts"] * with_offsets
    kinds = "doc_id long, n_tokens long, ids binary" + ", starts binary" * with_offsets
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrays.tidy(every), kinds)


class Decoder:
    """Bytes of ids by the reversed byte table; ids without a token are refused."""

    def __init__(self, tokenizer: tokenizers.Tokenizer):
        vocabulary, byte = json.loads(tokenizer.to_str())["model"]["vocab"], _byte_of()
        top = max(vocabulary.values()) + 1
        token = [b""] * top
        for shown, rank in vocabulary.items():
            token[rank] = bytes(byte[c] for c in shown)
        self.size = np.array([len(t) for t in token], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(token), np.uint8)

    def bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids and the offset of each id's bytes."""
        if len(ids) and (int(ids.max()) >= len(self.size) or (self.size[ids] == 0).any()):
            raise ValueError("an id has no token")
        many = self.size[ids]
        total = np.append(0, np.cumsum(many))
        return self.flat[np.repeat(self.first[ids] - total[:-1], many) + np.arange(total[-1])], total

    def text(self, ids, errors: str = "replace") -> str:
        """Text of some ids; a character that is cut at either end is handled by ``errors``."""
        return self.bytes(np.asarray(ids, np.uint32))[0].tobytes().decode("utf-8", errors)


def decode(encoded: DataFrame, tokenizer: Callable[[], tokenizers.Tokenizer]) -> DataFrame:
    """The rows of ``encode`` with their decoded bytes in place of other columns."""
    def every(batches):
        decoder = Decoder(tokenizer())
        for batch in arrays.pieces(batches, "ids"):
            ids, rows = arrays.unpacked(batch.column("ids"), "<u4")
            data, at = decoder.bytes(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(rows)), batch.column("ids"), arrays.packed(data, at[rows])],
                ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(arrays.tidy(every), "doc_id long, n_tokens long, ids binary, decoded binary")


def cut_pieces(docs: DataFrame, tokenizer: Callable[[], tokenizers.Tokenizer], end_id: int, limit: int, with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``limit``: ids of a text, then ``end_id``. Longer documents are cut
    from the end, so only the first piece may be shorter. ``ids_crc32`` names the ids of a piece."""
    def every(batches):
        encoder = Encoder(tokenizer())
        for batch in arrays.pieces(batches):
            ids, rows = encoder.batch(batch.column("text"))
            number = np.diff(rows) + 1
            held = np.full(len(ids) + len(number), end_id, "<u4")
            place = np.arange(len(ids)) + np.repeat(np.arange(len(number)), np.diff(rows))
            held[place] = ids
            begin = np.cumsum(number) - number
            count = -(-number // limit)
            row = np.repeat(np.arange(len(number)), count)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            short = number - (count - 1) * limit
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * limit)
            length = np.where(piece == 0, short[row], limit)
            edges = np.append(begin[row] + start, len(held))
            view = memoryview(held).cast("B")
            crc = np.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], np.int64)
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns + [arrays.packed(held, edges)] * with_ids, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrays.tidy(every), kinds)
