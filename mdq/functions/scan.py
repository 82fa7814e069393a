"""State machines over ordered rows as scans of composed functions.

What a row does to a machine of few states is a function from states to states: the list of the
images of all states. Composing such functions is associative, so the states before all rows of a
batch are a prefix composition, which is found by doubling: no loop over the rows of a key. One
state is handed from batch to batch, so the rows are shuffled and sorted once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: a key with a null, which equals no other, begins anew after so many rows
BLOCK = 64


def _after(images: np.ndarray, begins: np.ndarray, start: int, held: int) -> np.ndarray:
    """The state after each row; images has a row's image of every state, begins tells where the machine starts, held is its state where it goes on from the batch before."""
    place = np.arange(len(begins))
    first = np.maximum.accumulate(np.where(begins, place, 0))
    done, shift = images, 1
    while shift <= (place - first).max(initial=0):
        late = np.flatnonzero(place - first >= shift)
        done = done.copy()
        done[late] = np.take_along_axis(done[late], done[late - shift], axis=1)
        shift *= 2
    return done[place, np.where(begins[first], start, held)]


def state_before(df: DataFrame, keys: list[str], order: str, images: list[Column], start: int, name: str = "state") -> DataFrame:
    """Add the state a machine is in before each row; images[s] is the state after the row if it was s before.

    States are numbers from 0. Order is unique per key; null images keep the state. In a key with a
    null the state goes back to start every BLOCK rows.
    """
    names = [f"_f{s}" for s in range(len(images))]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    d = df.withColumns({"_whole": whole, "_rn": F.row_number().over(Window.partitionBy(*keys).orderBy(order)), **{n: F.coalesce(x, F.lit(s)).cast("int") for s, (n, x) in enumerate(zip(names, images))}})
    d = d.select(*df.columns, "_rn", "_whole", *names).sortWithinPartitions(*keys, "_rn")
    own = len(df.columns)
    schema = T.StructType([*d.schema.fields[:own], T.StructField(name, T.IntegerType())])

    def run(batches):
        held = start
        for batch in batches:
            if not batch.num_rows:
                continue
            number, whole_key, *steps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(own, batch.num_columns))
            begins = (number == 1) | (~whole_key & (number % BLOCK == 1))
            after = _after(np.stack(steps, axis=1), begins, start, held)
            before = np.where(number == 1, start, np.concatenate([[held], after[:-1]]))
            held = int(after[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(before.astype(np.int32))], names=schema.names)

    return d.mapInArrow(run, schema)
