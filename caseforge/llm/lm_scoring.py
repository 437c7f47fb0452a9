"""Language-model scoring with a weighted backoff automaton.

The model is an interpolated trigram model over all words of the training documents. Its
states are a root, the words seen as a context (and the document start), and the pairs of words
seen as a context ``LEAST_PAIR`` times or more. An arc reads a word seen after its state and
carries log10 of its smoothed probability. A failure arc leads from a pair to its last word,
from a word to the root, and carries log10 of the state's backoff weight. After a word the state
is the longest one that ends there. One left-to-right traversal of a text carries the state and
adds up the weights; the texts of a block are traversed together, all positions at once, as the
state after a word depends on the last two words alone.

Smoothing. Root: absolute discounting, ``(c - D) / N`` for a known word and ``D * V / N`` for
an unknown one, ``D = n1 / (n1 + 2 * n2)``. State ``h`` with the shorter ``g``:
``(1 - l) * c(h,w) / c(h) + l * p(w | g)``; ``l`` is the share of once-seen n-grams among the
tokens of all contexts whose count has the same binary logarithm (a leave-one-out estimate),
within 0.001 and 0.95.

Scale. Counts cover the whole corpus and are never gathered in one place: each block of
documents gets the part of the automaton that its texts can reach (see ``words``). N-grams are
told apart by 64-bit hashes. The orders are counted one after the other, so the keys of one
order only are on disk at a time, and a block asks only for n-grams whose context exists.

Cases. A null or empty text has one token, the end. A null id counts as an empty one for the
held-out rule. Rows with the same id are documents of their own. Without training documents
every word is unknown with probability 1 under the model; the base formula holds as it is. An id
that is no number is returned as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved
from .words import (
    BLOCK_BYTES,
    BUCKET_BYTES,
    REQUEST,
    answered,
    answers,
    answers_of,
    block_of,
    collapsed,
    mix,
    pair_keys,
    requests,
    shares,
    statistics_of,
    text_bytes,
    word_hashes,
)

END, START = mix(np.array([1, 2], np.uint64))
CLASSES = 64
LEAST, MOST = 0.001, 0.95
#: How often a pair of words must be seen to be a state.
LEAST_PAIR = 2
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n long"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n", pa.int64())])


class Grams:
    """Distinct n-grams of a block in the order of their keys.

    ``context`` and ``word`` are places of the context in the order below and of the word,
    ``n`` how often training documents of the block have it, ``at`` the n-gram of each token or -1.
    """

    def __init__(self, context: np.ndarray, token: np.ndarray, known: np.ndarray, train: np.ndarray, context_keys: np.ndarray, word_keys: np.ndarray):
        width = len(word_keys)
        code, place = np.unique(context[known] * width + token[known], return_inverse=True)
        keys = pair_keys(context_keys[code // width], word_keys[code % width])
        order = np.argsort(keys, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.keys, code = keys[order], code[order]
        self.context, self.word = code // width, code % width
        self.n = np.bincount(place, train[known], len(code)).astype(np.uint32)[order]
        self.at = np.full(len(token), -1)
        self.at[known] = rank[place]

    def sent(self, of_context: np.ndarray) -> np.ndarray:
        return np.stack([self.n, _log_class(of_context[self.context]).astype(np.uint32)], 1)


class Texts:
    """The tokens of a block: ``words`` (distinct, sorted), ``ids`` of all tokens, ``first`` tokens of documents, ``train`` per token."""

    def __init__(self, docs: pa.Table):
        hashes, sizes = word_hashes(docs["text"])
        self.sizes = sizes + 1
        ends = np.cumsum(self.sizes) - 1
        tokens = np.empty(len(hashes) + len(sizes), np.uint64)
        is_word = np.ones(len(tokens), bool)
        is_word[ends] = False
        tokens[is_word], tokens[ends] = hashes, END
        self.words, self.ids = np.unique(tokens, return_inverse=True)
        self.first = ends - sizes
        train = np.where(docs["held_out"].to_numpy(zero_copy_only=False).astype(bool), 0, docs["n"].to_numpy())
        self.train = np.repeat(train, self.sizes)

    def counts(self) -> np.ndarray:
        return np.bincount(self.ids, self.train, len(self.words)).astype(np.int64)

    def before(self, places: np.ndarray, at_start: int) -> np.ndarray:
        """``places`` of the tokens before."""
        out = np.empty_like(places)
        out[1:] = places[:-1]
        out[self.first] = at_start
        return out

    def pairs(self, count: np.ndarray, starts: int) -> tuple[Grams, np.ndarray]:
        """The bigrams whose words are known, and how often each context is seen: the words, then the document start."""
        of_context = np.append(count, starts)
        before = self.before(self.ids, len(self.words))
        known = (of_context[before] > 0) & (count[self.ids] > 0)
        return Grams(before, self.ids, known, self.train, np.append(self.words, START), self.words), of_context

    def triples(self, pairs: Grams, pair_count: np.ndarray, least_pair: int) -> Grams:
        """The trigrams whose context is a state and whose last two words are seen in turn."""
        if not len(pair_count):
            return Grams(self.ids, self.ids, np.zeros(len(self.ids), bool), self.train, self.words, self.words)
        before = self.before(pairs.at, -1)
        known = (before >= 0) & (pair_count[before] >= least_pair) & (pairs.at >= 0) & (pair_count[pairs.at] > 0)
        return Grams(before, self.ids, known, self.train, pairs.keys, self.words)


def _log_class(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(float))[1].astype(np.int64)


WORD_STATS = 4


def _add(place, sent):
    """Sums per word, and how many tokens and words there are and words seen once and twice."""
    total = np.bincount(place, sent[:, 0]).astype(np.int64)
    return total, np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64)


def _add_grams(place, sent):
    """Sums per n-gram, and per class of contexts the once-seen n-grams and the tokens."""
    total = np.bincount(place, sent[:, 0]).astype(np.int64)
    kind = np.zeros(len(total), np.int64)
    kind[place] = sent[:, 1]
    return total.astype(np.uint32) if total.max(initial=0) < 1 << 32 else total, np.concatenate([np.bincount(kind, total == 1, CLASSES), np.bincount(kind, total, CLASSES)]).astype(np.int64)


def _backoff(stats: np.ndarray) -> np.ndarray:
    """The backoff weight of each class of contexts."""
    return np.clip(stats[:CLASSES] / np.maximum(stats[CLASSES:], 1), LEAST, MOST)


class Automaton:
    """The part of the automaton that a block reaches.

    ``arcs[order]`` and ``failure[order]`` are log10 weights of the arcs out of and the failure arcs
    from states of ``order`` words, by their places in ``texts``; ``root`` has the arcs of the root.
    """

    def __init__(self, texts: Texts, counts: list[np.ndarray], stats: list[np.ndarray], starts: int, least_pair: int):
        count, pair_count, triple_count = counts
        tokens, known, once, twice = (int(x) for x in stats[0])
        self.texts, self.least_pair = texts, least_pair
        if tokens == 0:
            self.root = np.zeros(len(count))
            return
        discount = min(0.9, once / (once + 2 * twice)) if once else 0.5
        p = np.where(count > 0, (count - discount) / tokens, discount * known / tokens)
        self.pairs, of_context = texts.pairs(count, starts)
        self.triples = texts.triples(self.pairs, pair_count, least_pair)
        back = _backoff(stats[1])[_log_class(of_context)]
        seen = (1 - back[self.pairs.context]) * pair_count / of_context[self.pairs.context]
        # Of a pair not seen in training: what its failure arc and the root's arc come to.
        p2 = seen + back[self.pairs.context] * p[self.pairs.word]
        back3 = _backoff(stats[2])[_log_class(pair_count)]
        p3 = None
        if len(triple_count):
            own = self.triples.context
            # The shorter history's probability of a trigram's last word: by its token's own pair.
            shorter = np.zeros(len(own))
            has = self.triples.at >= 0
            shorter[self.triples.at[has]] = p2[self.pairs.at[has]]
            p3 = (1 - back3[own]) * triple_count / pair_count[own] + back3[own] * shorter
        self.root = np.log10(p)
        self.of_context, self.pair_count, self.triple_count = of_context, pair_count, triple_count
        self.failure2, self.failure3 = np.log10(back), np.log10(back3)
        self.arc2 = np.where(pair_count > 0, np.log10(p2), np.nan)
        self.arc3 = np.where(triple_count > 0, np.log10(p3), np.nan) if p3 is not None else np.zeros(0)

    def weights(self) -> np.ndarray:
        """What each token adds: its arc, with the failure arcs on the way to a state that has one."""
        t = self.texts
        out = self.root[t.ids]
        if not hasattr(self, "pairs"):
            return out
        # From a word: its arc, or its failure arc and the root's.
        word = t.before(t.ids, len(t.words))
        out = out + np.where(self.of_context[word] > 0, self.failure2[word], 0.0)
        at = self.pairs.at
        if len(self.arc2):
            arc = np.where(at >= 0, self.arc2[at], np.nan)
            out = np.where(np.isnan(arc), out, arc)
            # From a pair: its arc, or its failure arc and what follows.
            pair = t.before(at, -1)
            state = (pair >= 0) & (self.pair_count[pair] >= self.least_pair)
            out = out + np.where(state, self.failure3[pair], 0.0)
        if len(self.arc3):
            at = self.triples.at
            arc = np.where(at >= 0, self.arc3[at], np.nan)
            out = np.where(np.isnan(arc), out, arc)
        return out


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_pair: int = LEAST_PAIR, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Score every document under the base formula and under the automaton."""
    size = text_bytes(docs, text)
    blocks, buckets = shares(size, block_bytes), shares(size, bucket_bytes)
    held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 10 == 0
    plain = docs.select(F.expr(f"try_cast(`{doc_id}` as bigint)").alias("doc_id"), F.col(text).cast("binary").alias("text"), held_out.alias("held_out"))
    starts = plain.filter(~F.col("held_out")).count()
    by_block = collapsed(plain, "text").withColumn("block", block_of(blocks, "doc_id", "text")).groupBy("block")

    def known(told: pa.Table) -> list[np.ndarray]:
        """The counts of each order that the block has been told."""
        order = told["order"].to_numpy()
        return [answers(told.filter(pa.array(order == k))).astype(np.int64) for k in (1, 2, 3)]

    def no_request() -> pa.Table:
        return requests(0, np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), buckets)

    def count_words(key, table):
        t = Texts(table)
        return requests(key[0].as_py(), t.words, t.counts(), buckets)

    def count_pairs(key, docs_, told):
        if docs_.num_rows == 0:
            return no_request()
        grams, of_context = Texts(docs_).pairs(known(told)[0], starts)
        return requests(key[0].as_py(), grams.keys, grams.sent(of_context), buckets)

    def count_triples(key, docs_, told):
        if docs_.num_rows == 0:
            return no_request()
        t = Texts(docs_)
        count, pair_count, _ = known(told)
        grams = t.triples(t.pairs(count, starts)[0], pair_count, least_pair)
        return requests(key[0].as_py(), grams.keys, grams.sent(pair_count), buckets)

    told, stats = None, []

    def learn(asked: DataFrame, add, width: int) -> None:
        """Has an order counted, keeps its statistics and adds its answers to what blocks are told."""
        nonlocal told
        order = saved(answered(asked, add))
        stats.append(statistics_of(order, width))
        order = answers_of(order).withColumn("order", F.lit(len(stats)))
        told = order if told is None else told.unionByName(order)

    learn(by_block.applyInArrow(count_words, REQUEST), _add, WORD_STATS)
    learn(by_block.cogroup(told.groupBy("block")).applyInArrow(count_pairs, REQUEST), _add_grams, 2 * CLASSES)
    learn(by_block.cogroup(told.groupBy("block")).applyInArrow(count_triples, REQUEST), _add_grams, 2 * CLASSES)

    def traverse(docs_, told_):
        if docs_.num_rows == 0:
            return _OUT.empty_table()
        t = Texts(docs_)
        counts = known(told_)
        count = counts[0]
        tokens, distinct = int(stats[0][0]), int(stats[0][1])
        base = np.log10((count + 0.1) / (tokens + 0.1 * (distinct + 1)))[t.ids]
        each = [np.add.reduceat(x, t.first) for x in ((count > 0)[t.ids].astype(np.int64), base, Automaton(t, counts, stats, starts, least_pair).weights())]
        return pa.table([docs_["doc_id"], docs_["held_out"], t.sizes, each[0], np.full(len(t.sizes), tokens), *each[1:], docs_["n"]], schema=_OUT)

    scored = by_block.cogroup(told.groupBy("block")).applyInArrow(traverse, OUT)
    return scored.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
