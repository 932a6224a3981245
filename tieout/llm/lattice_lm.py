"""Log probabilities of whole texts under a subword lattice: all segmentations count, none is chosen.

The pieces and their weights come from an existing vocabulary file alone. A text is a chain of pieces drawn
one by one; its probability is the sum over all chains that spell it. No piece reaches across the start of a
word, so the sum is a product over words of the sums over their segmentations, which a forward recursion in
log space works out once for each different word of the corpus.

How a file's scores are read: those of a unigram file are natural logarithms of probabilities. A file of the
merge type has whole numbers in their place (0, -1, -2, ..., and one far below for pieces that no merge
makes), which only rank the pieces; there a piece of rank r weighs 1 / (RANK + r), Zipf's law. Bytes and the end have no score of their own and weigh as much as the least piece. Weights are made to
sum to 1 once; nothing of them is learnt. What is learnt are the word counts that base_score takes.

With counted, each token is one more arc of its lattice, over the whole of it: with N tokens to learn from, V
of them different, a token counted c times has probability (c + V * p) / (N + V), p being the sum over its
segmentations. So words that were met weigh as they were met, all others as the pieces spell them, and the
probabilities of all tokens still sum to 1 at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SPACE = "▁"
#: A word is frequent if it has over one in so many of the training tokens, so there are fewer frequent words than this.
FREQUENT = 1 << 19
#: Longest frequent word in bytes, which bounds what is broadcast.
FREQUENT_BYTES = 32
#: Where scores are ranks: the rank at which a piece weighs half as much as the first.
RANK = 200.0
#: Different words that a task counts before it passes them on.
HELD = 300_000
LOG10 = math.log(10)
END = "</s>"


def log_weights(scores: list[float]) -> list[float]:
    """The scores of a vocabulary as logarithms of weights, by what kind of file they are from."""
    if all(s == int(s) for s in scores):
        rank = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        return [-math.log(RANK + rank[s]) for s in scores]
    return list(scores)


class Pieces:
    """The log probabilities of a vocabulary's pieces, bytes and end."""

    def __init__(self, path: str):
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i))]
        names = [p.id_to_piece(i) for i in ids]
        weights = dict(zip(names, log_weights([p.get_score(i) for i in ids])))
        least = min(weights.values())
        weights |= {f"<0x{b:02X}>": least for b in range(256)} | {END: least}
        top = max(weights.values())
        total = top + math.log(sum(math.exp(w - top) for w in weights.values()))
        self.logs = {s: w - total for s, w in weights.items()}
        self.longest = max(map(len, names))


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def log_probability(word: str, logs: dict[str, float], longest: int) -> float:
    """The log of the sum over all segmentations, by a forward recursion in log space.

    A character that is no piece of its own is spelt by its bytes besides.
    """
    s = SPACE + word
    get, exp = logs.get, math.exp
    a = [0.0]
    for j in range(1, len(s) + 1):
        terms = [a[i] + x for i in range(max(0, j - longest), j) if (x := get(s[i:j])) is not None]
        if s[j - 1] not in logs:
            terms.append(a[j - 1] + sum(logs[f"<0x{b:02X}>"] for b in s[j - 1].encode()))
        top = max(terms)
        a.append(top if len(terms) == 1 else top + math.log(sum([exp(t - top) for t in terms])))
    return a[-1]


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, learn) -> (word, c): each word of these rows with its count in the rows to learn from."""
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    for b in batches:
        for text, learn in zip(b.column(0), b.column(1).to_pylist()):
            words = (text.as_py() or "").encode().lower().split()
            if learn:
                held.update(words)
            else:
                for w in set(words):
                    held.setdefault(w, 0)
            if len(held) >= HELD:
                yield out()
                held.clear()
    yield out()


def log10_mixed(c: int, lattice: float, n: int, v: int) -> float:
    """log10((c + v * 10 ** lattice) / (n + v)), finite however small the lattice's part is; without counts the lattice alone."""
    if not v:
        return lattice
    return (math.log10(c + v * 10**lattice) if c else math.log10(v) + lattice) - math.log10(n + v)


def lattice_scores(docs: DataFrame, path: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, counted: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs.

    Tokens are the words of the text, lower-cased in A-Z, and one end. The words of rows without held_out are
    counted. base_score adds log10((c + 1) / (N + V + 1)) over the tokens; score is the lattice's log10
    probability of the words and the end, and with counted that of the lattice together with the counts. Each different word is scored once and joined with the documents;
    frequent words, fewer than frequent whatever the input, are broadcast instead. A null or empty text is
    its end alone; texts and words of any length are scored whole; repeated rows each keep their row; a row
    with a null id is counted; other columns are ignored; an empty table gives an empty result, and
    with nothing to learn from every count is 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), out.alias("held_out"))
    words = rows.select("text", (~F.col("held_out")).alias("learn")).mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    words = checkpointed(words)
    n_docs = rows.agg(F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).first()[0]
    got = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = got[0] + n_docs, got[1] + (n_docs > 0)
    vocabulary = pieces(path)
    logs, longest = vocabulary.logs, vocabulary.longest

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lattice = [log_probability(_text(w), logs, longest) / LOG10 for w in b.column(0).to_pylist()]
            if counted:
                lattice = [log10_mixed(c, x, n, v) for c, x in zip(b.column(1).to_pylist(), lattice)]
            base = [math.log10((c + 1) / (n + v + 1)) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.float64()), pa.array(lattice, pa.float64())], names=["word", "c", "base", "lattice"])

    table = checkpointed(words.mapInArrow(scored, "word binary, c long, base double, lattice double"))
    # at most `frequent` words can have more than n / frequent of the n tokens each
    often = table.where((F.col("c") > n // frequent) & (F.col("c") > 0) & (F.octet_length("word") <= FREQUENT_BYTES))
    sent = docs.sparkSession.sparkContext.broadcast({bytes(r["word"]): (r["base"], r["lattice"]) for r in often.toLocalIterator()})
    last = logs[END] / LOG10
    end = (math.log10((n_docs + 1) / (n + v + 1)), log10_mixed(n_docs, last, n, v) if counted else last, int(n_docs > 0))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what its frequent words and its end add, and one for each other word of it."""
        known = sent.value
        get = known.get
        for b in batches:
            key, words, times, sums = [], [], [], []
            for k, text in zip(b.column(3).to_pylist(), b.column(1)):
                tokens = (text.as_py() or "").encode().lower().split()
                base, lattice, some = end
                for w, t in Counter(tokens).items():
                    if (x := get(w)) is not None:
                        base += t * x[0]
                        lattice += t * x[1]
                        some += t
                    else:
                        key.append(k)
                        words.append(w)
                        times.append(t)
                sums.append((base, lattice, some, len(tokens) + 1))
            keys = b.column(3).to_pylist()
            own = len(keys)
            # no word has a space in it, so these join with nothing, each at a place of its own
            words += [b" %d" % k for k in keys]
            m = len(key)
            none = lambda t: pa.nulls(m, t)
            both = lambda i, t: pa.concat_arrays([none(t), pa.array([s[i] for s in sums], t)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key + keys, pa.int64()), pa.array(words, pa.binary()), pa.array(times + [0] * own, pa.int64()), pa.concat_arrays([none(b.column(0).type), b.column(0)]), pa.concat_arrays([none(pa.bool_()), b.column(2)]), both(0, pa.float64()), both(1, pa.float64()), both(2, pa.int64()), both(3, pa.int64())],
                names=["key", "word", "times", "id", "held_out", "base_sum", "lattice_sum", "known_sum", "n_tokens"],
            )

    keyed = rows.select("id", "text", "held_out", F.monotonically_increasing_id().alias("key"))
    parts = keyed.mapInArrow(spread, f"key long, word binary, times long, id {kind}, held_out boolean, base_sum double, lattice_sum double, known_sum long, n_tokens long")
    joined = parts.join(table, "word", "left")
    t = F.col("times")
    out = joined.groupBy("key").agg(
        F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("known_sum") + F.sum(F.when(F.col("c") > 0, t).otherwise(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.max("base_sum") + F.sum(F.coalesce(t * F.col("base"), F.lit(0.0)))).alias("base_score"), (F.max("lattice_sum") + F.sum(F.coalesce(t * F.col("lattice"), F.lit(0.0)))).alias("score"),
    )
    return out.drop("key")
