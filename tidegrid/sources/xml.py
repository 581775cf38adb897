"""Subject files in XML: discovery, loading and parsing into the four streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.session import micros
from tidegrid.sources.adapters import number

#: Elements and attributes of the format, with the value column each attribute fills.
ELEMENTS = {
    "glucose_level": ("cgm", {"value": "glucose"}),
    "basal": ("insulin", {"value": "basal_insulin"}),
    "bolus": ("insulin", {"dose": "bolus_insulin"}),
    "meal": ("meal", {"carbs": "carbohydrates"}),
    "wearable": ("wearable", {"hr": "heart_rate", "eda": "eda", "temp": "skin_temperature", "acc_x": "accelerometer_x", "acc_y": "accelerometer_y", "acc_z": "accelerometer_z"}),
}
FORMAT_SCHEMA = "_id string, " + ", ".join(
    f"{element} struct<event: array<struct<_ts: string, {', '.join(f'_{a}: string' for a in attributes)}>>>" for element, (_, attributes) in ELEMENTS.items()
)


def parse_time(text: Column) -> Column:
    """ISO first, then day-month-year; anything else is an error."""
    parsed = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("dd-MM-yyyy HH:mm:ss")))
    return F.when(parsed.isNotNull(), parsed).when(text.isNotNull(), F.raise_error(F.concat(F.lit("unreadable time: "), text)).cast("timestamp"))


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names, without ending, of the XML files of a folder; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(path))
    return sorted(name[:-4] for name in names if name.endswith(".xml"))


def streams(files: DataFrame) -> DataFrame:
    """Stream records of parsed files (subject_id, parsed: struct by FORMAT_SCHEMA). Events without a time
    are dropped; seq is the place in the file within a stream."""
    parts = []
    for k, (element, (stream, attributes)) in enumerate(ELEMENTS.items()):
        events = files.select("subject_id", F.posexplode(f"parsed.{element}.event").alias("at", "event")).where(F.col("event._ts").isNotNull())
        own = {target: number(F.col(f"event._{a}")) for a, target in attributes.items()}
        values = [own.get(v, F.lit(None).cast("double")).alias(v) for v in schema.SIGNALS]
        seq = (F.col("at").cast("bigint") + F.lit(k) * F.lit(1 << 40)).alias("seq")
        parts.append(events.select("subject_id", F.lit(stream).alias("stream"), F.lit(schema.STREAMS.index(stream)).alias("rank"), seq, micros(parse_time(F.col("event._ts"))).alias("us"), *values))
    return reduce(DataFrame.unionByName, parts)


def parse(texts: DataFrame) -> DataFrame:
    """Stream records of texts (subject_id string, xml string). A malformed text gives no records."""
    parsed = F.from_xml("xml", FORMAT_SCHEMA, {"mode": "PERMISSIVE"})
    return streams(texts.select("subject_id", parsed.alias("parsed")))


def rendered(records: DataFrame) -> DataFrame:
    """Documents of the format, one a subject and day: (subject_id, day, xml). Values without a number are left out."""

    def event(when: Column, attributes: dict[str, str]) -> Column:
        written = [F.when(F.col(v).isNotNull(), F.concat(F.lit(f' {a}="'), F.col(v).cast("string"), F.lit('"'))) for a, v in attributes.items()]
        return F.when(when, F.concat(F.lit('<event ts="'), F.col("ts"), F.lit('"'), F.concat_ws("", *written), F.lit("/>")))

    ts = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = records.select("*", ts.alias("ts"), F.floor(F.col("us") / F.lit(86_400_000_000)).alias("day"))
    several = {e: len([x for x, (s, _) in ELEMENTS.items() if s == stream]) > 1 for e, (stream, _) in ELEMENTS.items()}
    firsts = {stream: element for element, (stream, _) in reversed(ELEMENTS.items())}
    texts = []
    for element, (stream, attributes) in ELEMENTS.items():
        mine = F.col("stream") == stream
        if several[element]:  # a record without any value goes to the first of its stream's elements
            others = [v for e, (s, a) in ELEMENTS.items() if s == stream and e != element for v in a.values()]
            bare = F.coalesce(*map(F.col, others)).isNull() if element == firsts[stream] else F.lit(False)
            mine = mine & (F.coalesce(*map(F.col, attributes.values())).isNotNull() | bare)
        texts.append(F.array_sort(F.collect_list(F.when(mine, F.struct("seq", event(mine, attributes).alias("e"))))).alias(element))
    whole = rows.groupBy("subject_id", "day").agg(*texts)
    parts = [F.concat(F.lit(f"<{e}>"), F.array_join(F.transform(e, lambda x: x["e"]), ""), F.lit(f"</{e}>")) for e in ELEMENTS]
    name = F.replace(F.replace(F.replace(F.col("subject_id"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return whole.select("subject_id", "day", F.concat(F.lit('<patient id="'), name, F.lit('">'), *parts, F.lit("</patient>")).alias("xml"))


def load_all(spark: SparkSession, folder: str) -> DataFrame:
    """Stream records of all documents of a folder, of which a file may hold many, read in tasks; the subject is the document's id.
    Malformed documents give none."""
    pieces = spark.read.text(folder, lineSep="</patient>")
    begin = F.instr("value", "<patient")
    whole = pieces.where(begin > 0).select(F.concat(F.substring("value", begin, F.length("value")), F.lit("</patient>")).alias("xml"))
    parsed = whole.select(F.from_xml("xml", FORMAT_SCHEMA, {"mode": "PERMISSIVE"}).alias("parsed"))
    return streams(parsed.select(F.col("parsed._id").alias("subject_id"), "parsed").where(F.col("subject_id").isNotNull()))


def load(spark: SparkSession, folder: str, subject: str) -> DataFrame:
    """Stream records of one subject's file; FileNotFoundError if there is none."""
    if subject not in discover(spark, folder):
        raise FileNotFoundError(f"{folder}/{subject}.xml")
    text = spark.read.text(f"{folder}/{subject}.xml", wholetext=True)
    return parse(text.select(F.lit(subject).alias("subject_id"), F.col("value").alias("xml")))
