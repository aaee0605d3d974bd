"""Count-only Viterbi: how many pieces a unigram tokenizer would cut each whole text into, without keeping the pieces.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each character; dynamic programming
carries the best score up to that character and the number of pieces on the way there. Tie rules are those of the public
unigram tokenizers: among equal scores the piece with the earliest start wins; a character that is no piece itself may be
unknown, at the lowest score less ten, and counts as its UTF-8 bytes where the vocabulary has byte pieces, else a run of
unknown ones counts once. Sums are exact in double precision.

Vocabulary and scores come from a public model file, whose pieces are taken as a unigram vocabulary. No piece of such a file
crosses from a word into the next word's space mark, so a text falls apart into words whose counts simply add up; each worker keeps
the counts of up to ``CACHED_WORDS`` words at hand. A vocabulary with such pieces is counted over whole texts.

Null and empty texts have no tokens. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from huntframe.llm.arrow_text import keyed, map_rows
from huntframe.llm.piece_model import BYTE, NORMAL, SPACE, USER_DEFINED, Normaliser, parse_model, read_model

#: Words a worker remembers; the memory is emptied when full. It changes the speed only.
CACHED_WORDS = 200_000
LONGEST_CACHED = 64
UNKNOWN_PENALTY = 10.0


class PieceCounter:
    def __init__(self, data: bytes):
        model = parse_model(data)
        self.normaliser = Normaliser(model)
        self.identity = self.normaliser.is_identity
        self.dummy = SPACE if model.add_dummy_prefix else ""
        self.byte_pieces = BYTE in model.kinds
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        lowest = 0.0
        words = True
        for piece, score, kind in zip(model.pieces, model.scores, model.kinds, strict=True):
            if kind in (NORMAL, USER_DEFINED) and piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
                lowest = min(lowest, score)
                words = words and SPACE not in piece.lstrip(SPACE)
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall if words else (lambda text: [text])
        self.cache: dict[str, int] = {}

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        if self.identity:
            return self.dummy + text.replace(" ", SPACE)
        return self.normaliser.normalise(text.encode())[0].decode()

    def viterbi(self, text: str) -> int:
        """Pieces on the best path over one normalised text."""
        n, single = len(text), self.single
        best, count, unknown_end = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = iter(self.automaton.iter(text))
        end, match = next(matches, (n, None))
        for at in range(n):
            top = pieces = None
            unknown = False
            while end == at:  # longest first: an equal score from a later start doesn't replace it
                size, score = match
                start = at + 1 - size
                score += best[start]
                if top is None or score > top:
                    top, pieces = score, count[start] + 1
                end, match = next(matches, (n, None))
            if text[at] not in single:
                score = best[at] + self.unknown
                if top is None or score > top:
                    top, unknown = score, True
                    if self.byte_pieces:
                        pieces = count[at] + len(text[at].encode())
                    else:
                        pieces = count[at] + (not unknown_end[at])
            best[at + 1], count[at + 1], unknown_end[at + 1] = top, pieces, unknown
        return count[n]

    def count(self, text: str) -> int:
        """Pieces of one source text."""
        total, cache = 0, self.cache
        for word in self.split(self.normalised(text)):
            known = cache.get(word)
            if known is None:
                known = self.viterbi(word)
                if len(word) <= LONGEST_CACHED:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = known
            total += known
        return total


@lru_cache(maxsize=2)
def counter(data: bytes) -> PieceCounter:
    """One counter per Python worker and vocabulary."""
    return PieceCounter(data)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None) -> DataFrame:
    """``key, n_tokens``: one narrow pass, no shuffle. An empty table gives an empty one, a text of any length is counted by one task, and an
    output that is named like the key gets a ``_`` at its end."""
    data = read_model(model_path)

    def rows(key, text):
        count = counter(data).count
        return ((k, count(t or "")) for k, t in zip(key, text, strict=True))

    return map_rows(df, {"key": key, "text": text}, keyed(df, key, n_tokens=T.LongType()), rows)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
