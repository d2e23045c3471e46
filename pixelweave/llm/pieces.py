"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

Texts are escaped as the vocabulary's own library does it (a space before the text, spaces as U+2581, nothing else
normalised). The automaton reads each character once; at every position it gives, along its output links, all pieces
that end there (longest first), and each relaxes the best score of that position. Characters without a piece cost UNKNOWN below the
worst piece and become byte pieces. Of equal scores the longer last piece wins. No piece has U+2581 after another character, nor a
line feed, so texts are cut before words and at line feeds, and the results of short cuts are remembered. Null texts are empty and give
no ids. Decoding gives the text back unless it held U+2581 itself, which comes back as a space. Texts are encoded whole, however long;
repeated rows give repeated results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import array
import functools
import hashlib
import math
import re

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import map_arrow, read, text_or_empty

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
UNKNOWN = 10.0
REMEMBERED, SHORT = 400_000, 40


class Codec:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.byte_id = [0] * 256
        self.raw: list[bytes] = []
        worst = 0.0
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_id[value] = k
                self.raw.append(bytes([value]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.raw.append(b"")
            else:
                score = sp.get_score(k)
                worst = min(worst, score)
                self.automaton.add_word(piece, (len(piece), score, k))
                if len(piece) == 1:
                    self.single.add(piece)
                if "\n" in piece or SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"cuts before words and at line feeds would break {piece!r}")
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN
        self.strange = (1, self.unknown, -1)
        self.known: dict[str, tuple[bytes, float]] = {}

    def viterbi(self, text: str) -> tuple[bytes, float]:
        """Ids (little-endian unsigned 32 bit) and score of escaped text."""
        n = len(text)
        best, back = [0.0] + [-math.inf] * n, [self.strange] * (n + 1)
        strange = iter([k for k, c in enumerate(text) if c not in self.single])
        p = next(strange, n)
        for end, piece in self.automaton.iter(text):
            while p < end:  # no piece ends at a character that has none
                best[p + 1] = max(best[p + 1], best[p] + self.unknown)
                p = next(strange, n)
            size, score, _ = piece
            score += best[end + 1 - size]
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, piece
        while p < n:
            best[p + 1] = max(best[p + 1], best[p] + self.unknown)
            p = next(strange, n)
        ids, p = [], n
        while p:
            size, _, k = back[p]
            if k < 0:
                ids += [self.byte_id[b] for b in reversed(text[p - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(k)
            p -= size
        ids.reverse()
        return array.array("I", ids).tobytes(), best[n]

    def _cut(self, cut: str) -> tuple[bytes, float]:
        found = self.known.get(cut)
        if found is None:
            found = self.viterbi(cut)
            if len(cut) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[cut] = found
        return found

    _CUTS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def encode(self, text: str) -> tuple[bytes, float]:
        if not text:
            return b"", 0.0
        found = [self._cut(c) for c in self._CUTS.findall(SPACE + text.replace(" ", SPACE))]
        return b"".join([f[0] for f in found]), float(sum([f[1] for f in found]))

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids as an array, score, decoded text) of each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary)
        found = [c.encode(t) for t in batch.column(1).to_pylist()]
        ids = [np.frombuffer(f[0], "<u4").astype(np.int32) for f in found]
        return pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.float64()), pa.array([c.decode(f[0]) for f in found], pa.string())], names=[key, "ids", "score", "decoded"])

    return map_arrow(df.select(F.col(key), text_or_empty(text)), run, f"{key} {kind}, ids array<int>, score double, decoded string", rows=256)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(VOCABULARY)
        texts = batch.column(1).to_pylist()
        found = [c.encode(t) for t in texts]
        back = [c.decode(f[0]) for f in found]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        columns = [batch.column(0), [len(f[0]) // 4 for f in found], [sha(f[0]) for f in found], [f[1] for f in found], [sha(t.encode()) for t in back], [a == b for a, b in zip(texts, back, strict=True)]]
        return pa.record_batch([columns[0], *[pa.array(v, t) for v, t in zip(columns[1:], (pa.int64(), pa.string(), pa.float64(), pa.string(), pa.bool_()), strict=True)]], names=["doc_id", "n_ids", "ids_sha256", "score", "decoded_sha256", "round_trip"])

    return map_arrow(docs.select("doc_id", text_or_empty()), digests, "doc_id bigint, n_ids bigint, ids_sha256 string, score double, decoded_sha256 string, round_trip boolean", rows=256)
