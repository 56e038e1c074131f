"""Unigram token counts: distinct pre-tokens share a trie, and forward scores are computed once a node."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import HashTable
from .common import BASE, BYTE_VALUES, buffers, each_text, powers, steps

#: Distinct pre-tokens in each of the two generations that a worker remembers.
CACHE_WORDS = 150_000
#: The mark of a word's start in the vocabulary, U+2581.
MARK = "▁".encode()
#: Score of a byte that no piece covers, below the lowest of the vocabulary.
BYTE_PENALTY = 10.0


def read_pieces(path: str) -> dict[bytes, float]:
    """The pieces of a sentencepiece file with their scores, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i).encode(): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class TrieCounter:
    """Best segmentation by the sum of piece scores; of equal sums the one with fewer tokens.

    A byte may always stand alone, at a score below every piece.
    """

    def __init__(self, pieces: dict[bytes, float]):
        ends: dict[bytes, float | None] = {}
        for piece in pieces:
            for i in range(1, len(piece)):
                ends.setdefault(piece[i:], None)
        ends.update(pieces)
        texts = list(ends)
        self.power = powers(BASE, max(map(len, texts), default=1) + 1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        stops, data = np.cumsum(sizes), np.frombuffer(b"".join(texts), np.uint8)
        place = np.repeat(stops, sizes) - 1 - np.arange(len(data))
        hashes = np.add.reduceat(BYTE_VALUES[data] * self.power[place], stops - sizes) if texts else np.zeros(0, np.uint64)
        self.table = HashTable(hashes, np.arange(len(texts), dtype=np.int32))
        self.scores = np.array([np.nan if x is None else x for x in ends.values()] or [np.nan])
        self.floor = min(pieces.values(), default=0.0) - BYTE_PENALTY

    def counts(self, words: list[bytes]) -> list[int]:
        """Tokens of each of the distinct words: the count stored at its node of the trie."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max(initial=0))
        text = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in words]), np.uint8).reshape(len(words), width)
        node = np.zeros(len(words), np.int64)  # of each word, at the level reached
        #: For each level: its nodes' parents, their last bytes, best scores and token counts.
        parents, values, score, count = [None], [None], [np.zeros(1)], [np.zeros(1, np.int64)]
        out = np.zeros(len(words), np.int64)
        for level in range(1, width + 1):
            live = np.flatnonzero(sizes >= level)
            edge = node[live] * 256 + text[live, level - 1]
            edges, own = np.unique(edge, return_inverse=True)
            node[live] = own
            parents.append(edges // 256)
            values.append(BYTE_VALUES[edges % 256])
            best = score[level - 1][parents[level]] + self.floor
            tokens = count[level - 1][parents[level]] + 1
            at = np.arange(len(edges))  # nodes whose suffix still ends some piece
            back = at
            hashed = np.zeros(len(edges), np.uint64)
            for length in range(1, min(level, len(self.power) - 1) + 1):
                hashed = hashed + values[level - length + 1][back] * self.power[length - 1]
                back = parents[level - length + 1][back]
                found = self.table.get(hashed)
                known = found >= 0
                if not known.any():
                    break
                at, back, hashed, found = at[known], back[known], hashed[known], found[known]
                piece = self.scores[found]
                total, more = score[level - length][back] + piece, count[level - length][back] + 1
                better = (total > best[at]) | ((total == best[at]) & (more < tokens[at]))
                best[at[better]], tokens[at[better]] = total[better], more[better]
            score.append(best)
            count.append(tokens)
            done = live[sizes[live] == level]
            out[done] = tokens[node[done]]
        return out.tolist()


_ready: dict[str, tuple] = {}


def token_counts(docs: DataFrame, pieces: dict[bytes, float], text_col: str = "text") -> DataFrame:
    """``docs`` with n_pretokens and n_tokens of every whole text.

    Pre-tokens are runs between ASCII white space, each led by the word mark. A null or empty text has
    none. The vocabulary (of fixed size) is broadcast. Like-named columns are replaced.
    """
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(TrieCounter(pieces))
    keep = [c for c in docs.columns if c not in ("n_pretokens", "n_tokens")]

    def run(batches):
        if key not in _ready:
            _ready.clear()
            _ready[key] = ({}, {})
        counter = shared.value
        for batch in batches:
            texts, words_, tokens = batch.column(text_col), [], []
            for i, j in steps(buffers(texts)[0], 4 << 20):
                split = [x.split() for x in each_text(texts.slice(i, j - i))]
                known, older = _ready[key]
                if len(known) > CACHE_WORDS:
                    known, older = _ready[key] = ({}, known)
                new = set().union(*split).difference(known)
                for x in [x for x in new if x in older]:
                    known[x] = older[x]
                    new.discard(x)
                parts: dict[int, list[bytes]] = {}
                for x in sorted(new):
                    parts.setdefault(len(x).bit_length(), []).append(x)
                for bits, some in parts.items():
                    rows = max(1, (1 << 22) >> bits)
                    for k in range(0, len(some), rows):
                        known.update(zip(some[k:k + rows], counter.counts([MARK + x for x in some[k:k + rows]])))
                words_ += map(len, split)
                tokens += [sum(map(known.__getitem__, x)) for x in split]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(words_, pa.int64()), pa.array(tokens, pa.int64())], [*keep, "n_pretokens", "n_tokens"])

    return docs.select(*keep).mapInArrow(run, ", ".join([f"`{c}` {dict(docs.dtypes)[c]}" for c in keep] + ["n_pretokens long, n_tokens long"]))


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, read_pieces(public_tokenizers.path("piece_bpe_32k.model"))).select("doc_id", "n_pretokens", "n_tokens")
