"""Token counts: count-only Viterbi over a unigram vocabulary.

A text's blanks become ``MARK``, one is put before the text, and the text is
cut before every mark, as a meta-space pre-tokenizer does.  In each segment an
Aho-Corasick automaton enumerates all vocabulary matches; dynamic programming
keeps, for every end, the best score and the number of pieces on its path.
No piece or id is ever built.

Tie rules (those of the unigram tokenizer): ends take a path only if its
score is strictly higher, starts come in ascending order, and the unknown
character is tried last at its start, only if no vocabulary piece is that
character alone.  Its score is the least score of the vocabulary less 10.
A run of unknown characters counts as its UTF-8 bytes where the vocabulary
has all byte pieces, else as one.

The vocabulary file is a parameter.  It is a BPE file whose scores are minus
the merge rank and no log-probabilities, so by default pieces get Zipf
log-probabilities by rank (``zipf``); ``file`` takes the file's scores.

Defined results: null and empty texts have no token; long texts without a
blank are one segment and take linear time; repeated rows are each answered;
extra columns are dropped.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_SEGMENTS = 600_000  # counts of short segments that a worker remembers
CACHE_CHARS = 24
NONE = float("-inf")  # the score of an end that no path has reached


def load_pieces(path: str, scores: str = "zipf") -> tuple[list[tuple[str, float]], int]:
    """(piece, score) by id, and the id of the unknown piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    if scores == "file":
        return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)], sp.unk_id()
    norm = math.log(sum(1.0 / (r + 1) for r in range(n)))
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
    out, rank = [], 0
    for i in range(n):
        if special[i]:
            out.append((sp.id_to_piece(i), -math.log(n) - norm))
        else:
            out.append((sp.id_to_piece(i), -math.log(rank + 1) - norm))
            rank += 1
    return out, sp.unk_id()


class Counter:
    """Counts tokens of texts; one per worker process."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.singles = {p for p in names if len(p) == 1}
        self.byte_pieces = all(f"<0x{b:02X}>" in names for b in range(256))
        self.cache: dict[str, int] = {}

    def segment(self, s: str) -> int:
        n = len(s)
        best, count = [0.0] + [NONE] * n, [0] * (n + 1)
        unknown = [False] * (n + 1)  # the path's last piece is an unknown character
        # Ends of characters that are no piece: after all matches there, the unknown piece is tried.
        odd = [i + 1 for i, c in enumerate(s) if c not in self.singles]
        at = 0
        for end, (size, score) in self.trie.iter(s):  # by end, earliest start first
            end += 1
            while at < len(odd) and odd[at] < end:
                self._unknown(s, odd[at], best, count, unknown)
                at += 1
            value = best[end - size] + score
            if value > best[end]:
                best[end], count[end] = value, count[end - size] + 1
        for e in odd[at:]:
            self._unknown(s, e, best, count, unknown)
        return count[n]

    def _unknown(self, s, e, best, count, unknown) -> None:
        value = best[e - 1] + self.unknown_score
        if value > best[e]:
            best[e], unknown[e] = value, True
            if self.byte_pieces:
                count[e] = count[e - 1] + len(s[e - 1].encode("utf-8", "surrogatepass"))
            else:
                count[e] = count[e - 1] + (not unknown[e - 1])

    def text(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(" ", MARK).split(MARK)
        if parts[0] == "" and len(parts) > 1:
            del parts[0]  # the text starts with a mark of its own
        total, cache = 0, self.cache
        for p in parts:
            n = cache.get(p)
            if n is None:
                n = self.segment(MARK + p)
                if len(p) <= CACHE_CHARS:
                    if len(cache) >= CACHE_SEGMENTS:
                        cache.clear()
                    cache[p] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str, scores: str) -> Counter:
    return Counter(*load_pieces(path, scores))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, scores: str = "zipf") -> DataFrame:
    """Per document: doc_id, n_chars (code points), n_tokens.

    ``vocabulary`` is a path that every executor can read.
    """

    def make(texts: pa.Array) -> list[pa.Array]:
        c = counter(vocabulary, scores)
        every = texts.to_pylist()
        return [pa.array([len(t) for t in every], pa.int64()), pa.array([c.text(t) for t in every], pa.int64())]

    fields = [T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())]
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out, _ = append_columns(narrow, F.col("text"), fields, make)
    return out.drop("text")
