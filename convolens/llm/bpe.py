"""Byte-level BPE: encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The tokenizer's file is named by a path that every executor can read; nothing of it is kept here.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import PreTokenizer

from convolens.llm import common as C

#: Fixed value: how the byte-level pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of which all Unicode versions agree whether they are letters, digits or white space. A text with others
#: is cut by the library itself, whose Unicode version decides.
AGREED = regex.compile(r"[^\u0000-\u0557\u0900-\u0BFF\u2010-\u206F\u20A0-\u20BF\u2190-\u23FF\u2500-\u27BF\u3000-\u312F\u4E00-\u9FA5\uAC00-\uD7A3\uFF00-\uFFEF\U0001F300-\U0001F5FF\U0001F600-\U0001F64F]")



def agreed(text: str) -> bool:
    """Whether a text has no other characters. Those up to U+053F need no look at the single characters."""
    return text.isascii() or np.frombuffer(text.encode(), np.uint8).max() < 0xD5 or not AGREED.search(text)


_OTHER, _LETTER, _DIGIT, _SPACE, _ODD = range(5)


@functools.cache
def kinds() -> np.ndarray:
    """What each character is to PATTERN: odd if Unicode versions differ on it, or if it is the zero character."""
    out = np.full(0x110000, _OTHER, np.uint8)
    text = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+"), (_ODD, AGREED.pattern + "+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    out[0] = _ODD
    return out


def cuts(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where PATTERN begins a piece, in UTF-8 bytes of texts behind one another, and which texts hold odd characters.

    `texts` says where each text begins, and at last where the bytes end. The cuts of texts with odd characters are void.
    """
    n, table = len(data), kinds()
    kind = table[:0x80][data & 0x7F]
    lead = np.flatnonzero(data >= 0xC0)
    for size, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)) if len(lead) else ():
        at = lead[(data[lead] >= low) & (data[lead] < high)]
        code = (data[at] & bits).astype(np.int64)
        for j in range(1, size):
            code = code << 6 | data[at + j] & 0x3F
        for j in range(size):
            kind[at + j] = table[code]
    odd = np.unique(np.searchsorted(texts, np.flatnonzero(kind == _ODD), "right") - 1)
    border = np.zeros(n + 3, bool)
    border[texts] = True
    # Runs of one kind; behind n lies room to look ahead.
    begin = border.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    # Of white space before anything else, the last character stands alone, or with what follows if it is a blank.
    after = np.flatnonzero(begin[1:n] & ~border[1:n] & (kind[:-1] == _SPACE)) + 1
    last = after - 1
    begin[after[data[last] == 0x20]] = False
    for _ in range(2):
        last -= (data[last] & 0xC0) == 0x80
    begin[last] = True
    # An apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    ahead = np.concatenate([data, np.zeros(3, np.uint8)])
    mark = np.flatnonzero(data == 0x27)
    mark = mark[begin[mark] & ~border[mark + 1]]
    a, b = ahead[mark + 1], ahead[mark + 2]
    one = np.isin(a, list(b"stmd"))
    two = ~border[mark + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    begin[mark[one | two] + 1] = False
    begin[mark[one] + 2] = True
    begin[mark[two] + 3] = True
    return np.flatnonzero(begin[:n]), odd


#: Pieces whose ids a worker remembers before those not met again are forgotten.
REMEMBERED = 400_000
_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    letters = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Merges:
    """Merges one piece: leaves are the pairs of neighbours, each node holds the least (rank, place) below it."""

    def __init__(self, ids: dict[str, int], merges: list):
        letters = byte_letters()
        self.single = [ids[x] for x in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {ids[a] << 32 | ids[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [ids[a + b] for a, b in pairs]

    def __call__(self, piece: bytes) -> tuple[int, ...]:
        ids = list(map(self.single.__getitem__, piece))
        n = len(ids)
        if n == 1:
            return tuple(ids)
        rank, merged = self.rank.get, self.merged
        bits = n.bit_length()
        mask = (1 << bits) - 1
        leaves = n - 1
        tree = [_NONE] * (2 * leaves)
        a = ids[0]
        for i in range(leaves):
            b = ids[i + 1]
            r = rank(a << 32 | b)
            if r is not None:
                tree[leaves + i] = r << bits | i
            a = b
        for k in range(leaves - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        while (top := tree[1]) != _NONE:
            i = top & mask
            gone = after[i]
            new = ids[i] = merged[top >> bits]
            ids[gone] = -1
            right = after[i] = after[gone]
            before[right] = i
            left = before[i]
            r = rank(new << 32 | ids[right]) if right < n else None
            changes = [(i, _NONE if r is None else r << bits | i)]
            if right < n:
                changes.append((gone, _NONE))
            if left >= 0:
                r = rank(ids[left] << 32 | new)
                changes.append((left, _NONE if r is None else r << bits | left))
            for leaf, value in changes:
                k = leaves + leaf
                while tree[k] != value:
                    tree[k] = value
                    if k == 1:
                        break
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
        return tuple([x for x in ids if x >= 0])


class Remembered(dict):
    """Ids of pieces, as far as they are remembered: since the last turn, or from the turn before."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            found = self.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Cutter:
    """A text's pieces, and the added tokens between them."""

    def __init__(self, spec: dict, path: str):
        self.path = path
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is read")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with conditions are not read")
        self.added = {t["content"]: t["id"] for t in added}
        self.findall = regex.compile(PATTERN).findall
        names = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    @functools.cached_property
    def library(self) -> PreTokenizer:
        return Tokenizer.from_file(self.path).pre_tokenizer

    def pieces(self, text: str) -> list[str]:
        if agreed(text):
            return self.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(id, []) of an added token, (None, pieces) of what stands between."""
        if self.split is None or not any(t in text for t in self.added):
            yield None, self.pieces(text)
            return
        for part in self.split(text):
            if part in self.added:
                yield self.added[part], []
            elif part:
                yield None, self.pieces(part)


class Codec:
    """Encodes and decodes texts as the file at `path` says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain merges are read")
        self.cutter = Cutter(spec, path)
        vocab = model["vocab"]
        self.known = Remembered(Merges(vocab, model["merges"]))
        byte = {x: b for b, x in enumerate(byte_letters())}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.cutter.added.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[x] for x in token)
        for token, i in self.cutter.added.items():
            self.bytes[i] = token.encode()

    def encode(self, text: str) -> list[int]:
        get = self.known.__getitem__
        out: list[int] = []
        for added, pieces in self.cutter.parts(text):
            if added is not None:
                out.append(added)
            else:
                out += chain.from_iterable(map(get, pieces))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


C.held(codec.cache_clear)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The token ids of each text, and with `decoded` the text that they decode to.

    Returns per row: id_col, ids, and decoded. A null text is empty and has no ids. Rows are taken one by one, in
    any order; ids may be null or repeat. A piece of any length takes n log n steps.
    """

    C.small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            sizes = C.text_bytes(batch.column(1))[1]
            for a, b in C.pieces(sizes, 2 * C.PIECE):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                ids = [own.encode(t or "") for t in texts]
                flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])

    schema = "id long, ids array<int>" + ", decoded string" * decoded
    out = docs.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"cast(`{text_col}` as string) AS text").mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids: id_col, text. Null ids are none; an unknown id fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    out = encoded.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"`{ids_col}` AS ids").mapInArrow(run, "id long, text string")
    return out.withColumnRenamed("id", id_col)
