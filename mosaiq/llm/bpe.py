"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash over its last 16 characters has a set pattern, every 128 characters on
average, so equal passages of different documents fall into equal chunks. A worker encodes each distinct
chunk once, for all documents that it meets. A cut may split a word, so each join is repaired: the piece
around it, from the last white space before to the first after it, is encoded anew, and a window of it
and its neighbours is encoded as one text. While the window's ids are not those of the spliced pieces,
the window doubles, until its outermost pieces agree or it is the whole text; its ids are then taken.

Results are those of the tokenizers library for the whole text, special tokens' strings included. Only
vocabularies of the kind whose word pattern is written down here are taken; others raise ValueError.

Null text: as an empty text, no ids and an empty decoded text. Any length and any characters are
allowed; equal rows get equal results; all other columns are left out unless named in `keep`. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, mapped, slices, tokenizer_path

_KINDS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}
_WIDTH, _BITS = 16, 7
_U = np.uint32
#: The only text pipeline for which white space parts pieces and `split` below finds the words.
PIPELINE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}


def _flat(text: str) -> str:
    """Only this white space cuts texts: the pieces between are independent in the vocabulary."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def cuts(texts: list[str], bits: int = _BITS) -> list[list[int]]:
    """For each text the positions, in code points, at which a chunk ends (the text's end excluded).
    They depend on the 16 characters before them alone."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = points * _U(0x9E3779B1)
    with np.errstate(over="ignore"):
        for step in (1, 2, 4, 8):
            turned = h[step:] + h[:-step] * _U(pow(0x85EBCA6B, step, 1 << 32))
            h = np.concatenate([h[:step], turned])
        at = np.flatnonzero(((h ^ (h >> _U(15))) * _U(0xC2B2AE35)) >> _U(32 - bits) == 0) + 1
    ends = np.cumsum([len(t) for t in texts])
    out, begin = [], 0
    for end in ends.tolist():
        a, b = np.searchsorted(at, (begin + _WIDTH, end))
        out.append((at[a:b] - begin).tolist())
        begin = end
    return out


class ChunkEncoder:
    """Encodes texts chunk by chunk. One is kept in each Python worker for each vocabulary file."""

    def __init__(self, path: str, bits: int = _BITS, limit: int = 150_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        given = json.loads(self.lib.to_str())
        if any(given.get(k) != v for k, v in PIPELINE.items()):
            raise ValueError(f"{path}: chunks of this vocabulary's texts can't be joined")
        self.lib.no_truncation()
        self.lib.no_padding()
        self.bits = bits
        self.tokens = np.array([self.lib.id_to_token(i) or "" for i in range(self.lib.get_vocab_size(with_added_tokens=True))], dtype=object)
        self.words = Memo(self._word, limit)
        #: How the vocabulary writes each byte as a character.
        self.written = {b: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0][-1] for b in range(128)}
        self.written |= {c: "".join(x for x, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))) for c in range(128, 256)}
        self.pieces = Memo(self._piece, limit)
        self.chunks = Memo(self._chunk, 60_000)
        #: Chunks and code points seen, and those of chunks seen before.
        self.seen, self.reused = [0, 0], [0, 0]
        #: The vocabulary's own word pattern for lower-case Latin-1 text without control characters.
        self.split = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall
        self.odd = re.compile(r"[^\x09\x0a\x0d\x20-\x7e\xa1-\xff]|<\|").search

    def _bytes(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return np.array([x.id for x in self.lib.model.tokenize(word if word.isascii() else word.translate(self.written))], "<u4").tobytes()

    def _piece(self, text: str) -> bytes:
        return self._bytes(text) if self.odd(text) else b"".join(map(self.words.__getitem__, self.split(text.lower())))

    def _run(self, text: str) -> bytes:
        """Ids of text that begins and ends at white space."""
        if self.odd(text):
            return b"".join(map(self.pieces.__getitem__, _flat(text).split(" ")))
        return b"".join(map(self.words.__getitem__, self.split(text.lower())))

    def _chunk(self, chunk: str) -> tuple[str, bytes, str, str, str] | None:
        """The part of a word at its start, ids of what lies between, the part at its end, and the
        first and last whole piece; None if the chunk has no white space."""
        flat = _flat(chunk)
        a, b = flat.find(" "), flat.rfind(" ")
        if a < 0:
            return None
        body = flat[a : b + 1]
        whole = body.strip(" ")
        return flat[:a], self._run(body), flat[b + 1 :], whole[: whole.find(" ")] if " " in whole else whole, whole[whole.rfind(" ") + 1 :]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, checks, chunks = [], [], self.chunks
        for k, (text, at) in enumerate(zip(texts, cuts(texts, self.bits), strict=True)):
            parts, carry, joined, before, begin = [], "", False, "", 0
            for end in [*at, len(text)]:
                chunk = text[begin:end]
                self.seen[0] += 1
                self.seen[1] += end - begin
                if chunk in chunks:
                    self.reused[0] += 1
                    self.reused[1] += end - begin
                got = chunks[chunk]
                if got is None:
                    joined = joined or bool(carry)
                    carry += _flat(chunk)
                else:
                    head, body, tail, first, last = got
                    if piece := carry + head:
                        parts.append(self.pieces[piece])
                        if begin:
                            checks.append((k, begin, before, piece, first))
                    parts.append(body)
                    carry, before = tail, last or piece or before
                begin = end
            if carry:
                parts.append(self.pieces[carry])
                if joined or at:
                    checks.append((k, len(text), before, carry, ""))
            out.append(b"".join(parts))
        for k, places in self._unequal(checks).items():
            out[k] = self._repaired(texts[k], places)
        for memo in (self.words, self.pieces, self.chunks):
            memo.trim()
        return out

    def _unequal(self, checks: list[tuple[int, int, str, str, str]]) -> dict[int, list[int]]:
        """Of each text the places of joins around which a window has other ids than its pieces together."""
        windows = dict.fromkeys(x[2:] for x in checks)
        found = self.lib.encode_batch_fast([" ".join(x) for x in windows], add_special_tokens=False)
        bad = {x for x, got in zip(windows, found, strict=True) if np.array(got.ids, "<u4").tobytes() != b"".join(self.pieces[p] for p in x if p)}
        out: dict[int, list[int]] = {}
        for k, place, *window in checks if bad else ():
            if tuple(window) in bad:
                out.setdefault(k, []).append(place)
        return out

    def _repaired(self, text: str, places: list[int]) -> bytes:
        """Ids of a text with joins at places where the pieces' ids don't hold."""
        flat = _flat(text)
        pieces = flat.split(" ")
        ids = [self._piece(p) for p in pieces]
        for place in places:
            j, reach = flat.count(" ", 0, place), 1
            while True:
                a, b = max(0, j - reach), min(len(pieces), j + reach + 1)
                got = self._bytes(" ".join(pieces[a:b]))
                if (a == 0 or got.startswith(ids[a])) and (b == len(pieces) or got.endswith(ids[b - 1])):
                    ids[a:b] = [got, *[b""] * (b - a - 1)]
                    break
                reach *= 2
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """As the library does without a decoder: tokens joined by a space, special ones included."""
        return " ".join(self.tokens[np.frombuffer(ids, "<u4")])


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def bpe_encode(
    docs: DataFrame,
    keep: list[str] | None = None,
    text: str = "text",
    emit: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    tokenizer: str | None = None,
    chunk_bits: int = _BITS,
) -> DataFrame:
    """A row for each of docs: the columns in `keep`, then those in `emit` (n_tokens, ids, decoded,
    ids_sha256 over ids as little-endian unsigned 32-bit integers, decoded_sha256 over UTF-8).
    chunk_bits: a chunk has 2 ** chunk_bits characters on average."""
    keep = [c for c in (keep or []) if c not in emit]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, _KINDS[c][0]) for c in emit])
    narrow = docs.select(*keep, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer or tokenizer_path("word_bpe_49k.json")
        if (coder := _encoders.get((path, chunk_bits))) is None:
            coder = _encoders[path, chunk_bits] = ChunkEncoder(path, chunk_bits)
        for batch in batches:
            for part, texts in slices(batch, "__text"):
                ids = coder.encode([t or "" for t in texts])
                made = {"n_tokens": lambda ids=ids: [len(x) // 4 for x in ids], "ids": lambda ids=ids: [np.frombuffer(x, "<i4") for x in ids], "ids_sha256": lambda ids=ids: [hashlib.sha256(x).hexdigest() for x in ids]}
                if {"decoded", "decoded_sha256"} & set(emit):
                    back = [coder.decode(x) for x in ids]
                    made |= {"decoded": lambda back=back: back, "decoded_sha256": lambda back=back: [hashlib.sha256(x.encode()).hexdigest() for x in back]}
                arrays = [part.column(i) for i in range(len(keep))] + [pa.array(made[c](), _KINDS[c][1]) for c in emit]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *emit])

    return mapped(narrow, run, schema)
