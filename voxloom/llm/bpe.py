"""Byte-pair encoding and decoding with a public vocabulary file.

Encoder: an Aho-Corasick automaton over the vocabulary finds the longest token at every place of a word. Tokens
are laid down from the left; each must be compatible with the one before it (a pair is compatible if the merges
of their joined text give exactly this pair), else the encoder backs up to the next shorter token, and places that
turned out to be dead ends are never entered again. This gives the merges' own result in time linear in the word.
Compatibility is kept in a table that fills as pairs are met. Words recur, so results are kept by word in a table of
bounded size.

Decoder: all tokens' texts lie in one byte string with a table of offsets; ids become a gather over it.

Text is prepared as the vocabulary file says: NFC, lower case (character by character), words by the file's
pattern, white space dropped, bytes mapped to printable characters; special tokens in a text keep their ids.

Edge cases: a null or empty text has no tokens and decodes to the empty text; repeated rows get equal results; the
longest texts are handled whole.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import bounded_batches

CACHE_WORDS = 400_000
_CONTROL = tuple("\x1c\x1d\x1e\x1f")
WHITE = regex.compile(r"\p{White_Space}+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a byte-level BPE vocabulary with an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        self.to_chars = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        # One private character stands for the end-of-word mark, so that a token's length is its length in the word.
        self.mark = "\uffff"
        marked = lambda t: t.removesuffix(end) + self.mark if t.endswith(end) else t
        pairs = [tuple(map(marked, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.parts = {}
        for left, right in pairs:
            self.parts.setdefault(left + right, (left, right))
        self.compatible: dict[tuple[str, str], bool] = {}
        self.spines: dict[str, tuple] = {}
        # tokens that the merges can give: base symbols, and merges that nothing forestalls
        self.token_id: dict[str, int] = {}
        names = {marked(t): i for t, i in vocab.items() if t not in self.special}
        for t, i in sorted(names.items(), key=lambda x: len(x[0])):
            if t not in self.parts or (all(p in self.token_id for p in self.parts[t]) and self._crossings(*self.parts[t]) == [self.parts[t]]):
                self.token_id[t] = i
        self.automaton = ahocorasick.Automaton()
        for t in self.token_id:
            self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()
        self.words: dict[str, bytes] = {}
        texts = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        pieces = [texts.get(i, "").encode() for i in range(max(texts) + 1)]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.blob = np.frombuffer(b"".join(p + b" " for p in pieces), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])

    def _spine(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """The token, its outer part on that side, that part's outer part and so on: (piece, rank of the merge that
        makes it, rank of the merge that takes it up)."""
        known = self.spines.get((token, side))
        if known is None:
            known, taken, piece = [], 1 << 30, token
            while piece is not None:
                parts = self.parts.get(piece)
                made = self.rank[parts] if parts else -1
                known.append((piece, made, taken))
                piece, taken = (parts[side], made) if parts else (None, made)
            self.spines[token, side] = known
        return known

    def _crossings(self, left: str, right: str) -> list[tuple[str, str]]:
        """Merges across the border that the merges of the joined text would make: of equal ranks the leftmost goes first."""
        found = []
        for a, a_made, a_taken in self._spine(left, 1):
            for b, b_made, b_taken in self._spine(right, 0):
                r = self.rank.get((a, b))
                if r is not None and a_made < r < a_taken and b_made < r <= b_taken:
                    found.append((a, b))
        return found

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stand side by side in the merges of their joined text."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            known = self.compatible[key] = not self._crossings(left, right)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, which is given in byte characters without the mark."""
        text = word + self.mark
        n = len(text)
        longest = [0] * n
        for end, length in self.automaton.iter(text):
            if length > longest[end - length + 1]:
                longest[end - length + 1] = length
        ids, compatible = self.token_id, self.compatible
        starts, tokens, dead = [], [], None
        at, length, before = 0, longest[0], None
        while at < n:
            while length:
                token = text[at : at + length]
                if token in ids and not (dead and dead[at + length]):
                    if before is None:
                        break
                    ok = compatible.get((before, token))
                    if ok or ok is None and self.fits(before, token):
                        break
                length -= 1
            if length:
                starts.append(at)
                tokens.append(token)
                before = token
                at += length
                length = longest[at] if at < n else 0
            else:
                if before is None:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
                dead = dead or bytearray(n + 1)
                dead[at] = 1
                at = starts.pop()
                length = len(tokens.pop()) - 1
                before = tokens[-1] if tokens else None
        return [ids[t] for t in tokens]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, as unsigned 32-bit integers."""
        if not text:
            return np.empty(0, "<u4")
        out: list[bytes] = []
        for part in self.split_special.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            part = unicodedata.normalize("NFC", part)
            if "Σ" in part:
                part = part.replace("Σ", "σ")
            part = part.lower()
            # str.split also cuts at four control characters that are no white space to the pattern
            chunks = WHITE.split(part) if any(c in part for c in _CONTROL) else part.split()
            known = self.words
            for chunk in chunks:
                ids = known.get(chunk)
                if ids is None:
                    ids = self._add(chunk)
                out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def _add(self, chunk: str) -> bytes:
        """Ids of what stands between white space."""
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        if len(self.compatible) >= CACHE_WORDS:
            self.compatible.clear()
        ids: list[int] = []
        for word in self.pattern.findall(chunk):
            ids += self.encode_word(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars))
        found = np.array(ids, "<u4").tobytes()
        if len(chunk) <= 64:
            self.words[chunk] = found
        return found

    def forget(self) -> None:
        """Empty the caches, so that an idle worker doesn't hold them."""
        self.words.clear()
        self.compatible.clear()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids: the tokens' texts joined by spaces, special tokens included."""
        if not len(ids):
            return b""
        ids = np.asarray(ids, np.int64)
        lengths = self.lengths[ids] + 1
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.blob[np.arange(ends[-1]) + shift].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def encode_table(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of token ids."""
    bounded_batches(docs.sparkSession)
    if ids_col in docs.columns:
        raise ValueError(f"there is a column {ids_col} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(text_col).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int32)]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], [*batch.schema.names, ids_col])
        bpe.forget()

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("array<int>").alias(ids_col)).schema)


def decode_table(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with a column of decoded texts."""
    bounded_batches(encoded.sparkSession)
    if text_col in encoded.columns:
        raise ValueError(f"there is a column {text_col} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            lists = batch.column(ids_col)
            flat = lists.flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()])]).astype(np.int64)
            texts = [bpe.decode(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            column = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, text_col])

    return encoded.mapInArrow(run, encoded.select("*", F.lit(None).cast("string").alias(text_col)).schema)


def ids_as_bytes(ids):
    """SQL expression: an array of ids as little-endian unsigned 32-bit integers."""
    reverse = lambda h: F.concat(*(F.substring(h, p, 2) for p in (7, 5, 3, 1)))
    return F.unhex(F.array_join(F.transform(ids, lambda i: reverse(F.lpad(F.hex(i), 8, "0"))), ""))


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes whole texts, decodes the ids, and digests both in one pass."""
    import hashlib

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
