"""Charts as one plan: reject, normalize, repair by data set, optimize, audit; then tokens and training records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

from . import audit, codec, records, tree

#: Repairs that each data set asks for, in their order; those before the optimizer and those after it.
REPAIRS: dict[str, Sequence[Callable[[tree.Element], object]]] = {
    "chartblocks": (tree.domain_axes,),
    "graphiq": (tree.line_fills,),
    "graphiq_clean": (tree.line_fills,),
    "fusion_clean": (tree.cjk_fonts,),
}
LATE: dict[str, Sequence[Callable[[tree.Element], object]]] = {"echarts": (tree.full_circles, tree.split_paint_order, tree.reveal_clips)}
LONGEST = 1_000_000
PRESERVE = "data-preserve-rendering"


def optimize_guarded(text: str, longest: int = LONGEST) -> tuple[str, bool]:
    if PRESERVE in text or len(text) > longest:
        return text, False
    return tree.optimize(text), True


def optimized(df: DataFrame, column: str, longest: int = LONGEST) -> DataFrame:
    """`df` with the column optimized, and whether it was: not if it asks to be preserved or is too long."""
    names = [c for c in df.columns if c != "optimized"]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + ["optimized boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(None, False) if t is None else optimize_guarded(t, longest) for t in batch.column(column).to_pylist()]
            cols = [pa.array([m[0] for m in made], pa.string()) if c == column else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([m[1] for m in made], pa.bool_())], [*names, "optimized"])

    return df.select(*names).mapInArrow(run, schema)


def chart(text: str, dataset: str | None, repairs: Mapping = REPAIRS, late: Mapping = LATE, longest: int = LONGEST) -> str:
    """One chart through all steps."""
    text = tree.normalize(text)
    for steps, then in ((repairs, True), (late, False)):
        root, _ = tree.parse(text)
        own = steps.get(dataset or "", ())
        if own and root is not None and sum(int(step(root) or 0) for step in own):
            text = tree.serialize(root)
        if then:
            text, _ = optimize_guarded(text, longest)
    return text


def clean(charts: DataFrame, datasets: Sequence[str] = (), column: str = "svg", dataset: str = "dataset") -> DataFrame:
    """Charts of the data sets asked for (none named: all), cleaned and audited, with state kept or rejected.

    Pages and error reports that stand in for a chart are rejected by their beginning, before anything is parsed; they
    have no chart and no findings. One pass over the charts, no shuffle.
    """
    if datasets:
        charts = charts.where(F.col(dataset).isin(*datasets))
    bad = F.coalesce(T.is_html_masquerade(F.col(column)), F.lit(True))
    seen = charts.withColumn("state", F.when(bad, "rejected").otherwise("kept")).withColumn(column, F.when(~bad, F.col(column)))
    names = seen.columns
    schema = ", ".join(f"`{c}` {seen.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if t is None else chart(t, d) for t, d in zip(batch.column(column).to_pylist(), batch.column(dataset).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if c == column else batch.column(c) for c in names], names)

    found = audit.audited(seen.mapInArrow(run, schema), column, dataset)
    kept = F.col("state") == "kept"
    return found.select(*names, *[F.when(kept, F.col(c)).alias(c) for c in found.columns if c not in names])


STAGES = ("clean", "audit", "encode", "records")


def prepared(charts: DataFrame, datasets: Sequence[str] = (), stages: Sequence[str] = STAGES, column: str = "svg", dataset: str = "dataset") -> DataFrame:
    """Charts of several data sets through the stages asked for, as one plan over all of them.

    A chart that fails stays, with its state (kept, rejected, too long, not encoded), so one data set's failures do not
    stop another's. `records` gives image (data set and id) and record, for charts that have tokens.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"no stages: {sorted(unknown)}")
    if "clean" in stages:
        df = clean(charts, datasets, column, dataset)
    else:
        df = (charts.where(F.col(dataset).isin(*datasets)) if datasets else charts).withColumn("state", F.lit("kept"))
    if "audit" in stages and "clean" not in stages:
        df = audit.audited(df, column, dataset)
    if "encode" in stages:
        plain = T.strip_images(T.strip_xml_declaration(F.col(column)))
        long = F.length(plain) > records.LENGTH_CAP
        df = df.withColumn("state", F.when((F.col("state") == "kept") & long, "too long").otherwise(F.col("state")))
        df = codec.encoded(df.withColumn("__svg", F.when(F.col("state") == "kept", plain)), "__svg").drop("__svg")
        df = df.withColumn("state", F.when(F.col("tokens") == "", "not encoded").otherwise(F.col("state"))).withColumn("tokens", F.nullif("tokens", F.lit("")))
    if "records" in stages:
        name = records.output_name(F.col(dataset))
        image = F.concat(F.lit("images/"), name, F.lit("/"), F.col("chart_id").cast("string"), F.lit(".png"))
        df = df.withColumn("record", F.when(F.col("tokens").isNotNull(), records.chat_record(F.col("tokens"), image)))
    return df


def outcome(charts: DataFrame, dataset: str = "dataset") -> DataFrame:
    """For each data set: charts, those kept, those that failed, and the first id that did."""
    failed = F.when(F.col("state") != "kept", F.col("chart_id"))
    return charts.groupBy(dataset).agg(F.count("*").alias("charts"), F.count_if(F.col("state") == "kept").alias("kept"), F.count(failed).alias("failed"), F.min(failed).alias("first_failed"))
