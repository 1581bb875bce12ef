"""Token counts of a unigram vocabulary by dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
MOST_NODES = 400_000
LONGEST_SHARED = 64
UNKNOWN_PENALTY = 10.0


class Trie:
    """Forward scores of prefixes: ``best`` and ``tokens`` have each node's score and its tokens, ``child`` the node that a
    node and a character lead to (numbers alone, which cost no garbage collection).

    A prefix is worked out once, however many pre-tokens begin with it; the terminal count of each pre-token is kept.
    At ``most_nodes`` nodes the trie, and at as many pre-tokens their counts, are forgotten and built anew, so memory is
    bounded. ``ends`` has every end of every piece, with the score of those that are pieces, so that looking back from a
    place stops where no piece can reach.
    """

    def __init__(self, scores: dict[str, float], most_nodes: int = MOST_NODES):
        self.scores, self.most = scores, most_nodes
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.ends = {p[i:]: scores.get(p[i:]) for p in scores for i in range(len(p))}
        self.counts: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = array("d", [0.0]), array("l", [0])

    def step(self, scores: list[float], tokens: list[int], word: str, end: int) -> tuple[float, int]:
        """The best segmentation of word[:end] from those of its prefixes (ties: the fewest tokens). A character in no
        piece is its UTF-8 bytes."""
        last, best, n, get = word[end - 1], None, 0, self.ends.get
        for start in range(end - 1, -1, -1):
            score = get(word[start:end], 0)  # scores are floats, so this 0 is no score
            if score is None:
                continue
            if score.__class__ is int:
                break
            score += scores[start]
            if best is None or score > best or score == best and tokens[start] < n:
                best, n = score, tokens[start]
        n += 1
        if last not in self.scores:
            score, own = scores[end - 1] + self.unknown, tokens[end - 1] + len(last.encode("utf-8", "replace"))
            if best is None or score > best or score == best and own < n:
                best, n = score, own
        return best, n

    def count(self, word: str) -> int:
        got = self.counts.get(word)
        if got is not None:
            return got
        if len(word) > LONGEST_SHARED:  # rare and long: not worth nodes
            scores, tokens = [0.0], [0]
            for end in range(1, len(word) + 1):
                score, n = self.step(scores, tokens, word, end)
                scores.append(score)
                tokens.append(n)
            return tokens[-1]
        if len(self.best) > self.most:
            self.reset()
        if len(self.counts) > self.most:
            self.counts.clear()
        scores, tokens = [0.0], [0]
        node, child, best_of, tokens_of, get, known = 0, self.child, self.best, self.tokens, self.ends.get, self.scores
        for end, c in enumerate(word, 1):
            key = node << 21 | ord(c)
            node = child.get(key)
            if node is None:
                best = None  # as in step(), without the calls
                for start in range(end - 1, -1, -1):
                    score = get(word[start:end], 0)
                    if score is None:
                        continue
                    if score.__class__ is int:
                        break
                    score += scores[start]
                    if best is None or score > best or score == best and tokens[start] < n:
                        best, n = score, tokens[start]
                if c not in known:
                    best, n = self.step(scores, tokens, word, end)
                else:
                    n += 1
                node = child[key] = len(best_of)
                best_of.append(best)
                tokens_of.append(n)
            scores.append(best_of[node])
            tokens.append(tokens_of[node])
        self.counts[word] = tokens[-1]
        return tokens[-1]


def piece_scores(path: str | None = None) -> dict[str, float]:
    """Pieces and scores of a sentencepiece file (default: the installed 32k one), without control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)))
    return {sp.id_to_piece(i): float(sp.get_score(i)) for i in plain}


def pretokens(text: str) -> list[str]:
    """Runs of spaces with the characters up to the next: no piece crosses from characters into a space."""
    return PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def token_counts(docs: DataFrame, model_path: str | None = None, most_nodes: int = MOST_NODES) -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens of every row of documents.

    The vocabulary's scores are taken as unigram log scores; a pre-token's tokens are those of its best segmentation
    (ties: the fewest), a character in no piece counts a token for each UTF-8 byte. Null and empty texts have none;
    null doc_ids and repeated rows are rows like others; an empty table gives no rows; other columns are ignored.
    Each task keeps its own bounded trie, so there is no shuffle and common words cost a look-up.
    """

    def run(batches):
        trie = Trie(piece_scores(model_path), most_nodes)
        for b in batches:
            chars, words, tokens = [], [], []
            for text in b.column(1):
                t = text.as_py() or ""
                own, n = pretokens(t), 0
                counts, count = trie.counts, trie.count
                for w in own:
                    got = counts.get(w)
                    if got is None:
                        got = count(w)
                        counts = trie.counts
                    n += got
                chars.append(len(t))
                words.append(len(own))
                tokens.append(n)
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in (chars, words, tokens))], names=["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_pretokens long, n_tokens long")


def op3_tokens(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
