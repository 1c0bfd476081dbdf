"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

Pre-tokens (words between white space, with the vocabulary's word mark in front) are inserted in a
trie. A node holds the best score of its prefix and the number of pieces on that path, computed once
from its ancestors however many words share the prefix; a word's count is kept at its end.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from letterloom.llm.common import annotate, free_name

MARK = "▁"
COUNTED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType())])

#: Characters of a pre-token that go into the trie; longer ones are computed alone.
TRIE_DEPTH = 48
#: Nodes after which a task starts a new trie.
TRIE_NODES = 600_000


def read_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary with log-probabilities by Zipf's law of their rank.

    The vocabularies at hand were made by merging, so their scores are only ranks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [
        i
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    ranked = sorted(usable, key=lambda i: (-model.get_score(i), i))
    total = sum(1.0 / (r + 3) for r in range(len(ranked)))
    return {model.id_to_piece(i): -math.log((r + 3) * total) for r, i in enumerate(ranked)}


class Trie(dict):
    """Pieces of each pre-token so far, from forward scores kept for all their prefixes.

    Of paths with equal scores the one with fewer pieces counts, so results do not depend on what
    else is in the trie. A character outside the vocabulary is spelled in UTF-8 bytes, one piece each,
    at 10 below the least score.
    """

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        #: Every end of a piece; those that are pieces themselves with their score.
        self.tails = {p[i:]: pieces.get(p[i:]) for p in pieces for i in range(len(p))}
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.reset()

    def reset(self) -> None:
        self.root: dict = {}
        self.nodes = 0
        self.clear()

    def step(self, path: list[tuple[float, int]], prefix: str) -> tuple[float, int]:
        """Best (score, minus pieces) of `prefix`; `path` has those of its shorter prefixes, '' first."""
        end, tails = len(prefix), self.tails
        best = (-math.inf, 0)
        for start in range(end - 1, -1, -1):
            tail = prefix[start:]
            if tail not in tails:
                break  # no piece ends in this, so none ends in more
            value = tails[tail]
            if value is not None:
                score, minus = path[start]
                way = (score + value, minus - 1)
                if way > best:
                    best = way
        if prefix[-1] not in self.pieces:
            score, minus = path[end - 1]
            best = max(best, (score + self.unknown, minus - len(prefix[-1].encode())))
        return best

    def __missing__(self, word: bytes) -> int:
        """Insert one pre-token."""
        text = MARK + word.decode(errors="replace")
        path = [(0.0, 0)]
        if len(text) > TRIE_DEPTH:
            for i in range(1, len(text) + 1):
                # only the last `longest` entries are looked at
                window = max(0, i - self.longest)
                path.append(self.step(path[window:], text[window:i]))
            return -path[-1][1]
        if self.nodes > TRIE_NODES:
            self.reset()
        children = self.root
        for i, letter in enumerate(text, 1):
            node = children.get(letter)
            if node is None:
                node = children[letter] = ({}, self.step(path, text[:i]))
                self.nodes += 1
            children = node[0]
            path.append(node[1])
        self[word] = n = -path[-1][1]
        return n


def _counter(pieces: dict[str, float]):
    def make():
        import gc

        trie = Trie(pieces)

        def counted(texts: list[bytes]):
            tokens, words = [], []
            # nodes hold no cycles: they go with their trie, and there is no garbage to look for among them
            gc.disable()
            try:
                for text in texts:
                    found = text.split()
                    tokens.append(sum(map(trie.__getitem__, found)))
                    words.append(len(found))
            finally:
                gc.freeze()
                gc.enable()
            return tokens, words

        return counted

    return make


def count_tokens(
    docs: DataFrame, pieces: dict[str, float], text: str = "text", name: str = "tokens"
) -> DataFrame:
    """`docs` with a struct column: n_tokens (pieces of the best segmentation of each word) and n_words.

    The best segmentation has the largest sum of piece scores, then the fewest pieces. Null and empty
    texts have no tokens. A task's trie holds at most TRIE_NODES nodes and begins anew beyond that.
    Extra columns are kept; `name` gets underscores if it is taken.
    """
    return annotate(docs, text, COUNTED, _counter(pieces), free_name(docs, name))
