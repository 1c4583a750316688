"""Places to plug models and tokenizers in. None is part of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tessera.functions.text import pair_assignment, strip
from tessera.operators.training import before_end, seen_end
from tessera.session import map_arrow, ship
from tessera.sources.writers import resumed


def with_model(rows: DataFrame, inputs: list[str], make: Callable[[], Callable[..., list]], name: str, kind: str, batch: int = 64) -> DataFrame:
    """``rows`` with a column ``name`` of type ``kind``: ``make()`` is called once per task and gives a function from lists of the inputs, ``batch``
    values each at most, to a list of as many results. For a generator of text (inputs: the prompt; kind: string), a scorer of two texts (double), or a
    tokenizer (array<int>)."""
    ship(rows.sparkSession)
    schema = rows.drop(name).schema.add(name, DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        model, wanted = make(), to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                values = model(*(part.column(part.schema.get_field_index(x)).to_pylist() for x in inputs))
                if len(values) != part.num_rows:
                    raise ValueError(f"{part.num_rows} rows, but {len(values)} results")
                columns = [part.column(part.schema.get_field_index(f.name)) for f in wanted if f.name != name]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values, wanted.field(name).type)], names=[f.name for f in wanted])

    return map_arrow(rows.drop(name) if name not in inputs else rows, run, schema)


def pair_scores(rows: DataFrame, key: str, predictions: str, references: str, make: Callable[[], Callable[[list, list], list]], name: str, batch: int = 64) -> DataFrame:
    """``rows`` with a column ``name``: the score of the better way to pair two predictions with two references. A scorer of two texts, ``make()``, sees only
    pairs of which neither text is blank; other pairs score nought. Without a scorer the column is null. ``key`` tells rows apart."""
    if make is None:
        return rows.withColumn(name, F.lit(None).cast("double"))
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    pairs = rows.select(key, predictions, references, place.alias("_at")).select(key, "_at", F.get(predictions, F.col("_at.i")).alias("_p"), F.get(references, F.col("_at.j")).alias("_r"))
    said = pairs.where((F.length(strip(F.col("_p"))) > 0) & (F.length(strip(F.col("_r"))) > 0))
    scored = with_model(said, ["_p", "_r"], make, "_score", "double", batch)
    of = lambda i, j: F.coalesce(F.max(F.when((F.col("_at.i") == i) & (F.col("_at.j") == j), F.col("_score"))), F.lit(0.0))
    best = scored.groupBy(key).agg(pair_assignment(of(0, 0), of(0, 1), of(1, 0), of(1, 1)).alias(name))
    return rows.drop(name).join(best, key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def generated(work: DataFrame, done: DataFrame | None, index: str, prompt: str, make: Callable[[], Callable[[list], list]], end: int, most: int, batch: int = 1) -> DataFrame:
    """(index, prompt, ids, ended, hit_limit) of the work that an interrupted run left (see ``resumed``): a generator of token ids, ``make()``, is asked for each prompt; ids are
    those before the end id, ``most`` at most, and without an end id an answer of that length has hit the limit."""
    rows = work if done is None else resumed(work, done, index, prompt)
    raw = with_model(rows.select(index, prompt), [prompt], make, "_ids", "array<int>", batch)
    cut = raw.withColumn("_ids", F.slice("_ids", 1, most))
    return cut.select(index, prompt, before_end(F.col("_ids"), end).alias("ids"), seen_end(F.col("_ids"), end).alias("ended"), (~seen_end(F.col("_ids"), end) & (F.size("_ids") >= most)).alias("hit_limit"))
