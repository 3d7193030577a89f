"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

_S, _REPS, _U = "__mx_source", "__mx_reps", "__mx_u"


def water_fill(sizes: Mapping, weights: Mapping, total: float, max_epochs: float) -> dict:
    """Epochs for each source so that amounts follow ``weights`` and sum up to ``total``.

    A source whose share would need more than ``max_epochs`` passes over its data is
    clamped there, and what it leaves is given to the others in proportion to their
    weights; this repeats until no source is above the cap. If all are clamped, the
    amount is below ``total``. Sources without weight or without data get 0.
    """
    open_ = {s for s, n in sizes.items() if n > 0 and weights.get(s, 0) > 0}
    epochs = dict.fromkeys(sizes, 0.0)
    left = float(total)
    while open_:
        mass = sum(weights[s] for s in sorted(open_, key=str))
        over = {s for s in open_ if left * weights[s] / mass > max_epochs * sizes[s]}
        if not over:
            for s in open_:
                epochs[s] = left * weights[s] / mass / sizes[s]
            break
        for s in over:
            epochs[s] = float(max_epochs)
            left -= max_epochs * sizes[s]
        open_ -= over
    return epochs


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    total: float | None = None,
    max_epochs: float = 4.0,
    seed: int = 17,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str | None = None,
) -> DataFrame:
    """``docs`` with each row repeated as its source's epochs say.

    Source sizes are characters of text, counted over all rows. ``weights`` defaults to
    equal weights, ``total`` to the size of ``docs``. Of a source with 2.3 epochs, each
    row is given twice and, if the seeded hash of its id falls below 0.3, once more, so a
    row's fate depends on the seed and its id only, not on the partitioning.

    The per-source totals (one row for each source) come to the driver, as the weights
    do; rows never leave their partition. A null source is a source of its own (key
    ``None``). Null texts count as empty; a source with no characters, or not in
    ``weights``, gives no rows. Rows with a null id share one draw per source. Repeated
    ids share their draw. ``copy_col`` adds the number of the copy, from 1; a column of ``docs``
    with that name is replaced. Long texts count whole. An empty table stays empty.
    """
    if copy_col in docs.columns:
        docs = docs.drop(copy_col)
    size = F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("bigint"))
    sizes = {r[0]: int(r[1]) for r in docs.groupBy(F.col(source_col).alias(_S)).agg(size.alias("__mx_n")).collect()}
    weights = dict.fromkeys(sizes, 1.0) if weights is None else dict(weights)
    epochs = water_fill(sizes, weights, sum(sizes.values()) if total is None else total, max_epochs)
    positive = {s: round(e, 9) for s, e in epochs.items() if e > 0}
    if not positive:
        out = docs.where(F.lit(False))
        return out.withColumn(copy_col, F.lit(1)) if copy_col else out
    known = {s: e for s, e in positive.items() if s is not None}
    reps = F.when(F.col(source_col).isNull(), F.lit(positive.get(None, 0.0)))
    if known:
        pairs = [F.lit(x) for kv in sorted(known.items()) for x in kv]
        reps = reps.otherwise(F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(source_col)), F.lit(0.0)))
    else:
        reps = reps.otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10)
    drawn = (
        docs.withColumn(_REPS, reps)
        .withColumn(_U, draw.cast("double") / F.lit(float(1 << 48)))
        .withColumn(_REPS, (F.floor(_REPS) + F.when(F.col(_U) < F.col(_REPS) - F.floor(_REPS), 1).otherwise(0)).cast("int"))
        .where(F.col(_REPS) > 0)
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    copy = F.explode(F.sequence(F.lit(1), F.col(_REPS))).alias(copy_col or "__mx_copy")
    return drawn.select(*columns, copy).select(*columns, *([copy_col] if copy_col else []))
