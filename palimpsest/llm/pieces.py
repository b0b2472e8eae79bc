"""SentencePiece models run by the tokenizers library.

The model's protobuf is read here, without a protobuf library. From it come the normaliser, the
metaspace marker, the scores (of a unigram model, or as merge ranks of a BPE model) and byte
fallback. Texts are encoded in batches, on several threads. Where the vocabulary lets a text fall
apart at its blanks, our side encodes each word once and strings the ids together. Sentencepiece
encodes every text whole; where the ids of a text differ, sentencepiece's stand and the row says so.
That holds for texts in which a byte or user piece of a unigram model is spelled out as well, which
the two libraries take differently. Ids are decoded by the tokenizers library.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
THREADS = 2
MARK = "▁"
#: Words that are encoded as one input.
LOT_WORDS = 1024
#: Goes before control and unused pieces of a unigram model: text never spells them.
_UNSPOKEN = "\ufdd0"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes of encoded words that a worker keeps from lot to lot, before it starts anew.
KNOWN_BYTES = 96 << 20
#: What an entry of such a table takes besides its word and ids.
_ENTRY = 180
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message; fixed-width values come as raw bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode("utf-8")
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            m.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    return m


def build(m: Model):
    """The same tokenizer in the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    usable = [(p, s) for p, s, k in m.pieces if k in (NORMAL, USER)]
    if m.kind == 1:
        model = models.Unigram([(_UNSPOKEN + p if k in (CONTROL, UNUSED) else p, s) for p, s, k in m.pieces], m.unk_id, m.byte_fallback)
    elif m.kind == 2:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        known = {p for p, _ in usable}
        merges = []
        for p, score in usable:
            merges += [(-score, vocab[p], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
        merges.sort()
        model = models.BPE(vocab=vocab, merges=[(a, b) for _, _, a, b in merges], unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
    else:
        raise ValueError("only unigram and BPE models are supported")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([*([decoders.ByteFallback()] if m.byte_fallback else []), decoders.Fuse(), decoders.Replace(MARK, " "), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    t.encode_special_tokens = True
    return t


class Codec:
    """Both libraries over one model."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import pre_tokenizers

        self.model, self.threads = parse(data), threads
        self.fast = build(self.model)
        self.plain, self.words = type(self.fast)(self.fast.model), type(self.fast)(self.fast.model)  # for text that is normalised already
        self.words.normalizer, self.words.pre_tokenizer = self.fast.normalizer, pre_tokenizers.Split(MARK, "merged_with_next")
        self.check = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.is_byte = np.array([k == BYTE for _, _, k in self.model.pieces])
        # Where no piece has a mark after another character, a text falls apart before every run of marks.
        self.apart = self.model.escape and not any(MARK in p.lstrip(MARK) for p, _, k in self.model.pieces if k in (NORMAL, USER))
        self.table = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.model.pieces]
        # The check library must not rewrite anything else, or a word's marks would not come through.
        self.apart = self.apart and self.model.dummy_prefix and not self.model.squeeze and not self.model.charsmap
        self.opens = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.known: dict[str, bytes] = {}  # ids of a mark and a word without marks
        self.chunks: dict[str, bytes] = {}  # ids of other chunks
        self.held = 0  # bytes of both

    def learn(self, words: list[str]) -> None:
        """Normalise and encode new words, many in one input and many inputs at once. The normaliser sets a mark
        before each, and no piece has a mark but at its beginning, so a word's ids begin where a piece with a
        mark stands."""
        lots = [words[at : at + LOT_WORDS] for at in range(0, len(words), LOT_WORDS)]
        for lot, got in zip(lots, self.words.encode_batch_fast([" ".join(lot) for lot in lots], add_special_tokens=False)):
            ids = np.array(got.ids, np.int32)
            cuts = np.flatnonzero(self.opens[ids]).tolist()
            if len(cuts) == len(lot) and cuts[0] == 0:
                data = ids.tobytes()
                self._keep(self.known, ((w, data[4 * i : 4 * j]) for w, i, j in zip(lot, cuts, [*cuts[1:], len(ids)])))
            else:
                self._keep(self.known, zip(lot, self._whole([MARK + w for w in lot])))

    def _keep(self, table: dict[str, bytes], entries) -> None:
        for w, ids in entries:
            table[w] = ids
            self.held += len(w) + len(ids) + _ENTRY

    def _forget(self) -> None:
        """Words that came first are the common ones: half of them stay."""
        old, self.known, self.chunks, self.held = self.known, {}, {}, 0
        for w, ids in old.items():
            self._keep(self.known, ((w, ids),))
            if 2 * self.held > KNOWN_BYTES:
                break

    def _whole(self, normal: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.int32).tobytes() for x in self.plain.encode_batch_fast(normal, add_special_tokens=False)]

    def _strung(self, texts: list[str]) -> list[bytes]:
        """Ids of each text from those of its chunks; a text falls apart before every run of marks.

        Here the normaliser only turns blanks into marks and sets one in front (see ``apart``). So a text with
        single blanks and no marks of its own falls into the words between its blanks, which are normalised
        once each in ``learn``; other texts are normalised whole. What is kept is bounded by its bytes, and
        one lot of texts."""
        plain = [bool(t) and t[0] != " " and "  " not in t and MARK not in t for t in texts]
        split = [t.split(" ") if p else _CHUNK.findall(self.fast.normalizer.normalize_str(t)) if t else [] for t, p in zip(texts, plain)]
        if self.held > KNOWN_BYTES:
            self._forget()
        known, chunks = self.known, self.chunks
        self.learn(list(set().union(*(s for s, p in zip(split, plain) if p)).difference(known)))
        fresh = list(set().union(*(s for s, p in zip(split, plain) if not p)).difference(chunks))
        self._keep(chunks, zip(fresh, self._whole(fresh)))
        return [b"".join(map((known if p else chunks).__getitem__, s)) for s, p in zip(split, plain)]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text (32-bit, as bytes), by the tokenizers library alone."""
        if self.apart:
            return self._strung(texts)
        return [np.array(x.ids, np.int32).tobytes() for x in self.fast.encode_batch_fast(texts, add_special_tokens=False)]

    def coded(self, texts: list[str]) -> tuple[list[bytes], list[list[int]], list[bool]]:
        """Ids of each text as 32-bit numbers, the same as a list, and whether sentencepiece, on the whole text, has
        the same; its own if not."""
        theirs = self.check.encode(texts, num_threads=self.threads)
        held = [array("i", b).tobytes() for b in theirs]
        ours = self.ids_of(texts)
        same = [a == b for a, b in zip(ours, held)]
        return [a if ok else b for a, b, ok in zip(ours, held, same)], theirs, same

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text and whether both libraries agree on them."""
        ids, _, same = self.coded(texts)
        return [np.frombuffer(x, np.int32).tolist() for x in ids], same

    def decode(self, ids: list[list[int]]) -> list[str]:
        """By the tokenizers library."""
        return self.fast.decode_batch(ids, skip_special_tokens=False)

    def spell(self, ids: list[int]) -> str:
        """The same from the piece table, to hold against ``decode``: marks are blanks, byte pieces bytes."""
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def codec(data: bytes, threads: int = THREADS) -> Codec:
    """One codec for each model in a worker process, kept between its tasks."""
    import sys

    kept = sys.__dict__.setdefault("_piece_codecs", {})
    key = hashlib.sha256(data).hexdigest(), threads
    if key not in kept:
        kept[key] = Codec(data, threads)
    return kept[key]


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: Texts go to the library in lots of so many characters, whatever a batch's size.
LOT_CHARS = 1 << 21


def _lots(texts: list[str]) -> Iterator[list[str]]:
    lot, size = [], 0
    for t in texts:
        lot.append(t)
        size += len(t)
        if size >= LOT_CHARS:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """``(doc_id, ids, n_tokens, n_byte_tokens, decoded, parity)`` for each row of ``docs``.

    Null and empty texts give no ids and decode to an empty text; repeated rows and null ids keep
    their rows; an empty table gives an empty table; further columns are ignored. The model is read
    once, here, and its bytes travel with the function.
    """
    data = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data, threads)
        for b in batches:
            parts, same, back = [], [], []
            for lot in _lots([t or "" for t in b.column(1).to_pylist()]):
                ids, lists, ok = c.coded(lot)
                back += c.decode(lists)
                same += ok
                parts += ids
            flat = np.frombuffer(b"".join(parts), np.int32)
            ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)))
            upto = np.concatenate(([0], np.cumsum(c.is_byte[flat]))) if len(flat) else np.zeros(1, np.int64)
            counts, n_bytes = np.diff(ends), np.diff(upto[ends])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), ids, pa.array(counts, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(back, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_tokens", "n_byte_tokens", "decoded", "parity"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, n_byte_tokens bigint, decoded string, parity boolean")
