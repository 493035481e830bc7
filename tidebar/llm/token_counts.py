"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

The vocabulary is the piece list of a public tokenizer file with the scores that the file gives (`vocabulary`). A text is cut before
each run of white-space marks as the tokenizer's pre-tokenizer does, so the pieces of one word never depend on another word. Within a word an
Aho-Corasick automaton enumerates all vocabulary matches; dynamic programming over character positions carries
(best score, piece count). Tie rules are those of the tokenizers library's Unigram model: start positions are visited from left to right,
a path replaces another one only with a strictly greater score, and a character without a piece of its own competes as unknown with the lowest score
minus 10; an unknown character counts as its UTF-8 bytes (byte fallback) or, with byte_fallback=False, consecutive unknowns count once.

Results: null or empty text has 0 tokens. Repeated rows each have their count. Long texts are processed whole; memory per task is bounded by
one Arrow batch and the word memo. Nothing is shuffled.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, per_worker, table, text_udf

UNKNOWN_PENALTY = 10.0
MARK = "▁"


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) by id, as the file has them; like the tokenizers library's Unigram model, every entry is an ordinary piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class CountOnlyViterbi:
    """Counts the pieces of the best segmentation of a word; keeps no path."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.trie = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.words = Memo(self.count_word)

    def best(self, word: str) -> tuple[float, int]:
        """(best score, number of pieces) of one word."""
        n = len(word)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score) in self.trie.iter(word):
            matches[end - length + 1].append((length, score))
        score_at: list[float | None] = [None] * (n + 1)
        count_at, unknown_at = [0] * (n + 1), [False] * (n + 1)
        score_at[0] = 0.0
        for i in range(n):
            here, count = score_at[i], count_at[i]
            single = False
            for length, score in matches[i]:
                j, total = i + length, here + score
                single |= length == 1
                if score_at[j] is None or total > score_at[j]:
                    score_at[j], count_at[j], unknown_at[j] = total, count + 1, False
            if not single:
                j, total = i + 1, here + self.unknown
                if score_at[j] is None or total > score_at[j]:
                    more = len(word[i].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not unknown_at[i])
                    score_at[j], count_at[j], unknown_at[j] = total, count + more, True
        return score_at[n], count_at[n]

    def count_word(self, word: str) -> int:
        return self.best(word)[1]

    def count(self, text: str | None) -> int:
        """The text gets a leading mark, each space is a mark, and a word starts at each mark."""
        if not text:
            return 0
        words, of = text.replace(MARK, " ").split(" "), self.words
        if words[0] == "":  # the text starts with a mark of its own
            words = words[1:]
        return sum([of[MARK + w] for w in words])


def count_tokens(docs: DataFrame, model_file: str, text_col: str = "text", into: str = "n_tokens", byte_fallback: bool = True) -> DataFrame:
    """docs with a long column `into`: the number of tokens of each whole text."""
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file))  # bounded by the vocabulary file

    def make():
        counter = per_worker(("viterbi", model_file, byte_fallback), lambda: CountOnlyViterbi(pieces.value, byte_fallback))
        return lambda texts: {"n": [counter.count(t) for t in texts]}

    return docs.withColumn(into, text_udf(make, "n long")(F.col(text_col))["n"])


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


