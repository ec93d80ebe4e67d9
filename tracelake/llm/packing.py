"""Filling contexts of a fixed capacity with documents.

Documents are counted in tokens of a public tokenizer. Those longer than the
capacity give full pieces and a remainder; all other pieces are packed whole.
Pieces are dealt by a hash of their id into blocks of bounded size, and each block
is packed on its own by minimum bin slack: the longest piece left opens a bin, a
bitset of reachable sums over the lengths left finds the fullest feasible
combination, and its pieces are removed.

Defined results: a document without tokens (null or empty text) gets no bin and
does not come out; repeated document ids count once; every other document comes
out with all of its tokens, in one piece if it is not longer than the capacity.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces packed together. A block leaves at most one bin of its own partly filled for want of pieces.
BLOCK = 4_000
TOKENIZER = "byte_bpe_50k.tiktoken"
_ENCODERS: dict = {}


def _encoder(path: str | None):
    """The tokenizer of this process, by its path; the default is found where the public files are installed."""
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "doc_id bigint, n_tokens bigint")


def fullest(lengths: list[tuple[int, int]], room: int) -> list[int]:
    """The lengths of a combination with the greatest sum not over ``room``.

    ``lengths`` has (length, count) in falling order. Bit s of ``reach`` says that
    some combination sums to s.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in lengths:
        if length > room:
            continue
        count, power = min(count, room // length), 1
        while count > 0:  # counts by powers of two, so that any number up to the count can be taken
            take = min(power, count)
            wider = (reach | reach << take * length) & mask
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            count, power = count - take, power * 2
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> left & 1:
            out += [length] * take
            left -= take * length
    return out


def pack_block(items: list[tuple[int, object]], capacity: int) -> Iterator[list[object]]:
    """Bins of the names in ``items``, (length, name) with lengths from 1 to ``capacity``."""
    names: dict[int, list] = defaultdict(list)
    for length, name in items:
        names[length].append(name)
    while names:
        top = max(names)
        chosen = [names[top].pop()]
        if not names[top]:
            del names[top]
        if top < capacity:
            for length in fullest([(n, len(names[n])) for n in sorted(names, reverse=True)], capacity - top):
                chosen.append(names[length].pop())
                if not names[length]:
                    del names[length]
        yield chosen


def pack(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget, capacity_tokens, doc_id, piece, tokens, bin_id) from (doc_id, n_tokens) and (budget, capacity_tokens).

    Pieces are numbered from 0 in text order; all but the last have exactly the
    capacity, and such a full piece is a bin of its own. Budgets with a null name or no capacity pack nothing.
    """
    sizes = sizes.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0")
    budgets = budgets.where("capacity_tokens > 0 and budget is not null").groupBy("budget").agg(F.max("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    blocks = sizes.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).alias("blocks"))
    pieces = sizes.crossJoin(F.broadcast(budgets.crossJoin(blocks)))
    full = F.floor(F.col("n_tokens") / F.col("capacity_tokens"))
    whole = pieces.where("n_tokens >= capacity_tokens").select("budget", "capacity_tokens", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece"), F.col("capacity_tokens").alias("tokens"))
    whole = whole.withColumn("bin_id", F.concat_ws("/", F.lit("full"), "doc_id", "piece"))
    rest = pieces.where("n_tokens % capacity_tokens > 0").select("budget", "capacity_tokens", "doc_id", full.cast("bigint").alias("piece"), (F.col("n_tokens") % F.col("capacity_tokens")).alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "doc_id"]).reset_index(drop=True)
        bins = pd.Series(-1, index=group.index)
        for n, rows in enumerate(pack_block(list(zip(group["tokens"].tolist(), group.index)), int(group["capacity_tokens"].iloc[0]))):
            bins[rows] = n
        block = str(group["block"].iloc[0])
        group["bin_id"] = block + "/" + bins.astype(str)
        return group[["budget", "capacity_tokens", "doc_id", "piece", "tokens", "bin_id"]]

    schema = "budget string, capacity_tokens bigint, doc_id bigint, piece bigint, tokens bigint, bin_id string"
    return whole.unionByName(rest.groupBy("budget", "block").applyInPandas(run, schema))


def fill(packed: DataFrame) -> DataFrame:
    """(budget, capacity_tokens, n_bins, n_documents, tokens, unused_share) per budget."""
    bins = packed.groupBy("budget", "capacity_tokens").agg(F.count_distinct("bin_id").alias("n_bins"), F.count_distinct("doc_id").alias("n_documents"), F.sum("tokens").alias("tokens"))
    return bins.withColumn("unused_share", 1 - F.col("tokens") / (F.col("n_bins") * F.col("capacity_tokens")))
