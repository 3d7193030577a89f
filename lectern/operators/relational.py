"""Relational kit: unique and priority joins, interval joins, ordered runs, bounded keeps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from lectern.session import spread


def unique_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)`` of the keys that exactly one row has; null and '' are no keys."""
    return df.where((F.col(key).isNotNull()) & (F.col(key).cast("string") != "")).groupBy(key).agg(F.count("*").alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def ambiguous_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of the keys that several rows have."""
    return df.where((F.col(key).isNotNull()) & (F.col(key).cast("string") != "")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, name: str) -> DataFrame:
    """``left`` with the right side's ``value`` as ``name`` where exactly one right row has the key, else null."""
    found = unique_keys(right, right_key, value).select(F.col(right_key).alias("__uk"), F.col(value).alias(name))
    return left.join(found, F.col(left_key) == F.col("__uk"), "left").drop("__uk")


def containing(points: DataFrame, spans: DataFrame, doc: str, lo: str, hi: str, begin: str, end: str, value: str, width: int = 4096) -> DataFrame:
    """``points`` with ``value`` of the only span of the same document that holds [lo, hi]; null if none or several do.

    Spans meet ranges by document and buckets of ``width`` offsets, so that one long
    document is spread over many tasks; a range is looked up where it begins.
    """
    cells = F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width)))
    s = spans.select(F.col(doc).alias("__d"), F.col(begin).alias("__b"), F.col(end).alias("__e"), F.col(value), cells.alias("__c"))
    p = points.withColumn("__c", F.floor(F.col(lo) / width)).withColumn("__row", F.struct(*points.columns))
    hit = p.join(s, (F.col(doc) == F.col("__d")) & (p["__c"] == s["__c"]) & (F.col("__b") <= F.col(lo)) & (F.col(hi) <= F.col("__e")), "left")
    n = hit.groupBy(*points.columns).agg(F.count("__b").alias("__n"), F.min(value).alias(value))
    return n.withColumn(value, F.when(F.col("__n") == 1, F.col(value))).drop("__n")


def last_at_or_before(queries: DataFrame, marks: DataFrame, doc: str, at: str, mark_at: str, value: str) -> DataFrame:
    """As-of join: for each query the ``value`` of the last mark at or before it; null before the first."""
    extra = [c for c in queries.columns if c not in (doc, at)]
    q = queries.select(doc, F.col(at).alias("__at"), F.lit(1).alias("__kind"), *extra, F.lit(None).cast(marks.schema[value].dataType).alias(value))
    m = marks.select(doc, F.col(mark_at).alias("__at"), F.lit(0).alias("__kind"), *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in extra], value)
    w = Window.partitionBy(doc).orderBy("__at", "__kind")
    return q.unionByName(m).withColumn(value, F.last(value, True).over(w)).where("__kind = 1").select(doc, F.col("__at").alias(at), *extra, value)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "run") -> DataFrame:
    """``name``: how many breaks there were up to the row, by keys and order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(breaks.cast("int")).over(w))


def merge_intervals(df: DataFrame, keys: Sequence[str], begin: str, end: str) -> DataFrame:
    """Union of overlapping or touching intervals."""
    w = Window.partitionBy(*keys).orderBy(begin, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(df.withColumn("__new", reach.isNull() | (F.col(begin) > reach)), keys, [begin, end], F.col("__new"), "__run")
    return runs.groupBy(*keys, "__run").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count("*").alias("n")).drop("__run")


def rows_of_texts(docs: DataFrame, doc: str, text: str, schema: str, rows_of: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """Rows of ``rows_of(text)`` for each document, with the document's id; null and empty texts give none. Copies of a text within a batch are read once."""
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    fields = T.StructType([T.StructField(doc, source.schema["doc"].dataType), *T._parse_datatype_string(schema).fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, list[tuple]] = {None: [], "": []}
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = known.get(t)
                if found is None:
                    found = known[t] = list(rows_of(t))
                rows += [(i, *row) for row in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], fields.names)

    return spread(source, "doc").mapInArrow(run, fields)


def fold_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], taken: Sequence[str], keep: Callable[[], Callable[..., bool]]) -> DataFrame:
    """Rows that ``keep()``, made anew for each group of ``keys``, takes; it is asked with the columns ``taken``, row by row in order.

    Groups come one after another in sorted tasks, so that neither their number nor their size counts: nothing is held but the state.
    """
    rows = spread(df, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ask = None, None
        for batch in batches:
            of = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            kept = []
            for n, (g, *values) in enumerate(zip(of, *(batch.column(c).to_pylist() for c in taken))):
                if ask is None or g != group:
                    group, ask = g, keep()
                if ask(*values):
                    kept.append(n)
            yield batch.take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(run, df.schema)


def _apart() -> Callable[[object, object], bool]:
    """Takes the first interval, and those that don't begin before the last taken one ends; an end that is null is never reached."""
    reach, first = None, True

    def ask(begin, end) -> bool:
        nonlocal reach, first
        if first or (begin is not None and reach is not None and begin >= reach):
            reach, first = end, False
            return True
        return False

    return ask


def fold_groups(df: DataFrame, key: str | Sequence[str], order: Sequence[str], begin: str, end: str) -> DataFrame:
    """Rows of each group in order, nulls last, without those that begin before the last kept one ends. Linear in the rows."""
    return fold_rows(df, [key] if isinstance(key, str) else key, [F.col(c).asc_nulls_last() for c in order], [begin, end], _apart)


def greedy_intervals(df: DataFrame, keys: Sequence[str], begin: str, end: str) -> DataFrame:
    """Intervals taken in order of begin, then end; one that overlaps the last taken is skipped."""
    rows = df.select(*keys, F.col(begin).cast("bigint").alias(begin), F.col(end).cast("bigint").alias(end))
    return fold_groups(rows, keys, [begin, end], begin, end)


def lru_keep(df: DataFrame, at: str, size: str, key: str, max_entries: int, max_bytes: int, scope: Sequence[str] = ()) -> DataFrame:
    """Entries that stay when the oldest go until both limits hold; ties go by key.

    The running totals from the newest entry on equal the eviction loop. Without ``scope``
    the order is global: entries are first cut to what could stay by count, in parallel.
    """
    order = [F.col(at).desc(), F.col(key)]
    if not scope:
        df = df.orderBy(*order).limit(max_entries)
    w = Window.partitionBy(*(scope or [F.lit(0)])).orderBy(*order)
    run = df.withColumn("__n", F.row_number().over(w)).withColumn("__s", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("__n") <= max_entries) & (F.col("__s") <= max_bytes)).drop("__n", "__s")


def first_nonempty(value: Column, order: Column) -> Column:
    """Aggregate: the first value, by ``order``, that is neither null nor '' nor 0."""
    good = value.isNotNull() & (value.cast("string") != "") & (value.cast("string") != "0")
    return F.min_by(F.when(good, value), F.when(good, order))


def greedy_batches(df: DataFrame, keys: Sequence[str], order: str, tokens: str, counted: str, max_items: int, max_tokens: int) -> DataFrame:
    """``(keys, order, batch)``: items packed in order into batches.

    A batch that isn't empty is closed before an item that counts and would be one too many,
    or that would exceed the tokens. Batches without a counted item are dropped and take no number.
    """
    rows = df.select(F.struct(*keys).alias("__g"), F.col(order), F.col(tokens).cast("bigint").alias("__t"), F.col(counted).alias("__c"))
    schema = T.StructType([rows.schema["__g"], rows.schema[order], T.StructField("__b", T.IntegerType()), rows.schema["__c"]])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending")])
        out, b, n, k, s = [], 1, 0, 0, 0
        for t, c in zip(table.column("__t").to_pylist(), table.column("__c").to_pylist()):
            if n and ((c and k >= max_items) or s + t > max_tokens):
                b, n, k, s = b + 1, 0, 0, 0
            n, k, s = n + 1, k + bool(c), s + t
            out.append(b)
        return pa.table({"__g": table.column("__g"), order: table.column(order), "__b": pa.array(out, pa.int32()), "__c": table.column("__c")})

    packed = rows.groupBy("__g").applyInArrow(pack, schema).select("__g.*", order, "__b", "__c")
    packed = packed.withColumn("__any", F.max(F.col("__c").cast("int")).over(Window.partitionBy(*keys, "__b"))).where("__any = 1")
    return packed.withColumn("batch", F.dense_rank().over(Window.partitionBy(*keys).orderBy("__b")).cast("bigint")).drop("__b", "__c", "__any")
