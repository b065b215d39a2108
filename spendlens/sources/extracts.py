"""Raw extract readers (CSV and the JSON layouts) and source dispatch.

Every value is read as text; typing happens in ``operators.clean``.
"""
from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..config import shared_path, write_table
from ..schema import HEADER_MAP, NA_TOKENS


def _null_na_tokens(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """Missing-value tokens of the CSV reader become NULL in every column."""
    toks = [F.lit(t) for t in tokens]
    return df.select(*[F.when(F.col(f"`{c}`").isin(*toks), F.lit(None))
                        .otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_csv_extract(spark: SparkSession, path: str, na_tokens=NA_TOKENS,
                     encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Header CSV, UTF-8 (a BOM is dropped), every column as text.

    Files are split and read in parallel by Spark; quoted fields may hold the
    delimiter (``"1,234"``).  ``multi_line=True`` accepts quoted line breaks
    at the cost of reading each file in one task.
    """
    def read(files) -> DataFrame:
        return (spark.read.option("header", True).option("encoding", encoding).option("escape", '"')
                .option("multiLine", multi_line).option("inferSchema", False).csv(files))

    parts = []
    for files in _files_by_header(spark, path, encoding):
        names = read(files).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "__more"]])
        rows = (spark.read.schema(schema).option("header", True).option("encoding", encoding).option("escape", '"')
                .option("multiLine", multi_line).csv(files))
        # A row with more fields than the header fails the read; a shorter one has missing values.
        first = F.when(F.col("__more").isNotNull(), F.raise_error(F.lit("a CSV row has more fields than its header")).cast("string"))
        parts.append(rows.select(F.coalesce(first, F.col(f"`{names[0]}`")).alias(names[0]), *[F.col(f"`{n}`") for n in names[1:]]))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else read(path)
    return _null_na_tokens(df, na_tokens)


#: Above any file's size: no file is cut, and no two share a task.
_WHOLE_FILE = str(1 << 50)


def _first_lines(spark: SparkSession, path, encoding: str, n: int, line) -> list[tuple[str, list]]:
    """The first ``n`` lines of each file for which the expression ``line`` is not
    null, as it has them.  A task is one file and stops reading once it has its
    lines.  Files without such a line are left out."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", _WHOLE_FILE)
    session.conf.set("spark.sql.files.openCostInBytes", _WHOLE_FILE)
    lines = session.read.option("encoding", encoding).text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line"))

    def head(rows):
        file, found = None, []
        for row in rows:
            if row["line"] is not None:
                file = row["file"]
                found.append(row["line"])
                if len(found) == n:
                    break
        if found:
            yield file, found

    return sorted(lines.rdd.mapPartitions(head).collect())


def _files_by_header(spark: SparkSession, path, encoding: str) -> list[list[str]]:
    """The files of a CSV source grouped by header line, the first that is not
    blank: columns are matched by name, so files with another column order are
    read apart.  Files with blank lines only have no rows.  Only the beginning of
    a file is read, and only the file names and headers reach the driver."""
    value = F.regexp_replace("value", "^\ufeff", "")
    # Blank as Spark's header inference has it: nothing but spaces.
    groups: dict[str, list[str]] = {}
    for file, (header,) in _first_lines(spark, path, encoding, 1, F.when(F.trim(value) != "", value)):
        groups.setdefault(header.rstrip("\r"), []).append(file)
    return [files for _, files in sorted(groups.items())]


def _json_rows(spark: SparkSession, path: str, multi_line: bool, mode: str = "FAILFAST") -> DataFrame:
    """Malformed JSON fails the read (``FAILFAST``) instead of turning into
    all-NULL rows that imputation would then fill."""
    return (spark.read.option("multiLine", multi_line).option("mode", mode)
            .option("primitivesAsString", True).json(path))


def _records_from_keyed(spark: SparkSession, path: str) -> DataFrame:
    """Object of objects (id -> record): one row per inner object."""
    docs = spark.read.text(path, wholetext=True)
    recs = docs.select(F.explode(F.from_json(
        "value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())), {"mode": "FAILFAST"}
    )).alias("_id", "rec"))
    # Field names: distinct keys of all records -- a tiny result.
    names = sorted(r[0] for r in recs.select(F.explode(F.map_keys("rec"))).distinct().collect())
    return recs.select(*[F.col("rec")[n].alias(n) for n in names])


def _pick_records_key(schema: T.StructType, records_key: str | None) -> str | None:
    if records_key is not None:
        return records_key
    cands = [f for f in schema.fields
             if isinstance(f.dataType, T.ArrayType)
             and isinstance(f.dataType.elementType, (T.StructType, T.StringType))]
    if not cands:
        return None
    known = set(HEADER_MAP) | set(HEADER_MAP.values())
    for f in cands:
        et = f.dataType.elementType
        if isinstance(et, T.StructType) and known & set(et.fieldNames()):
            return f.name
    return cands[0].name


#: Documents of more bytes are cut into records before they are parsed.
SPLIT_OVER = 128 << 20
#: Files of up to so many bytes are read whole to tell their layout, many in a task:
#: what opening a file costs by Spark's reckoning.  A larger one has a task of its own,
#: which stops behind its first lines.
WHOLE_UP_TO = 4 << 20
#: The blanks of a regular expression's ``\s``.
_BLANKS = " \t\n\x0b\f\r"
#: Characters at a line's end that are looked at before the whole line is.
_TAIL = 64


def _text(value: Column) -> Column:
    """A line or document from its first character on that is no blank."""
    return F.ltrim(value, F.lit(_BLANKS + "\ufeff"))


def _last(line: Column) -> Column:
    """The last character of a line that is no blank.  A line may be a whole
    document, so it is looked at from its end and not searched."""
    tail = F.rtrim(F.right(line, F.lit(_TAIL)), F.lit(_BLANKS))
    return F.substring(F.when(tail != "", tail).otherwise(F.rtrim(line, F.lit(_BLANKS))), -1, 1)


def detect_json_layouts(spark: SparkSession, path) -> dict[str, list[str]]:
    """The files of a JSON source by layout, judged by their first two lines
    that are not blank.

    A file that begins with ``[`` is an array; one whose first line begins with
    ``{`` and ends with ``}`` and whose second begins with ``{`` is JSON Lines, as
    no single document looks like that; any other is one object, read whole:
    ``wrapped`` if one of its values is a list, ``keyed`` if all are objects, else a
    single ``record``.  Only file names and layouts reach the driver.
    """
    out, told = _told_files(spark, path, SPLIT_OVER)
    for r in told.select("file", "kind").collect() if told is not None else ():
        out.setdefault(r["kind"], []).append(r["file"])
    return {kind: sorted(files) for kind, files in out.items()}


def _told_files(spark: SparkSession, path, over: int) -> tuple[dict[str, list[str]], DataFrame | None]:
    """The files of a JSON source by layout where their first lines tell it, and
    ``_told_documents`` of all others."""
    large, small = _large_files(spark, path, WHOLE_UP_TO)
    out: dict[str, list[str]] = {}
    if large:
        value = F.col("value")
        ends = F.concat(F.substring(_text(value), 1, 1), _last(value))
        for file, found in _first_lines(spark, large, "UTF-8", 2, F.when(_text(value) != "", ends)):
            kind = "array" if found[0][0] == "[" else "lines" if len(found) == 2 and found[0] == "{}" and found[1][0] == "{" else "object"
            out.setdefault(kind, []).append(file)
    told = [_told_documents(spark, files, over, objects) for files, objects in ((small, False), (out.pop("object", []), True)) if files]
    return out, reduce(DataFrame.unionByName, told) if told else None


def _told_documents(spark: SparkSession, path, over: int, objects: bool) -> DataFrame:
    """``file, kind, names, records`` of JSON files read whole, but for blank ones;
    ``objects`` says that all are single objects.

    An object of up to ``over`` bytes is parsed as an object of records first, which only
    a keyed one is, so one parse tells its layout, its ``records`` and their fields'
    ``names`` (null for any other).  Values of others, and of larger ones, whose records
    would not fit in memory beside each other, are kept as text to be told apart."""
    as_map = T.MapType(T.StringType(), T.StringType())
    docs = (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                    F.when(F.startswith("value", F.lit("\ufeff")), F.substr("value", F.lit(2))).otherwise(F.col("value")).alias("value")))
    if objects:
        docs = docs.withColumn("layout", F.lit("object"))
    else:
        text = _text(F.col("value"))
        more = F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
        docs = (docs.withColumn("first", F.substring(text, 1, 1)).where(F.col("first") != "")
                .withColumn("lines", F.when((F.col("first") == "{") & more, F.split(text, "[\r\n]", 2)))
                .withColumn("layout", F.when(F.col("first") == "[", "array")
                            .when((F.size("lines") == 2) & (_last(F.col("lines")[0]) == "}") & F.startswith(_text(F.get("lines", F.lit(1))), F.lit("{")), "lines")
                            .otherwise("object")))
    # Each parse is a column of its own, so that it is not repeated for every use.
    docs = (docs.withColumn("records", F.map_values(F.when((F.col("layout") == "object") & (F.col("size") <= over),
                                                           F.from_json("value", T.MapType(T.StringType(), as_map)))))
            .withColumn("keyed", F.coalesce((F.size("records") > 0) & F.forall("records", lambda r: r.isNotNull()), F.lit(False)))
            .withColumn("values", F.map_values(F.when((F.col("layout") == "object") & ~F.col("keyed"), F.from_json("value", as_map)))))
    kind = (F.when(F.col("layout") != "object", F.col("layout")).when(F.col("keyed"), "keyed")
            .when(F.exists("values", lambda v: v.startswith("[")), "wrapped")
            .when((F.size("values") > 0) & F.forall("values", lambda v: F.coalesce(v.startswith("{"), F.lit(False))), "keyed").otherwise("record"))
    names = F.when(F.col("keyed"), F.array_sort(F.array_distinct(F.flatten(F.transform("records", lambda r: F.map_keys(r))))))
    return docs.select("file", kind.alias("kind"), names.alias("names"), F.when(F.col("keyed"), F.col("records")).alias("records"))


def _read_auto(spark: SparkSession, path, records_key: str | None, split_over: int) -> list[DataFrame]:
    """Records of JSON files, every file by its own layout.

    The records of keyed documents are stored as the layouts are told, in the shared
    folder, so that these documents are parsed once: the fields of the first document
    as columns, others, which only the whole source tells, beside them as a map."""
    kinds, told = _told_files(spark, path, split_over)
    names = None
    if told is not None:
        first = told.select("names").first()
        columns = (first and first["names"]) or []
        known = F.array(*[F.lit(n) for n in columns]).cast("array<string>")
        more = F.col("names").isNotNull() & (F.size(F.array_except("names", known)) > 0)

        def row(rec, *about):  # a record, or what is told about a file
            about = about or [F.lit(None).cast(told.schema[c].dataType) for c in ("file", "kind", "names")]
            return F.struct(*[v.alias(c) for c, v in zip(("file", "kind", "names"), about)], F.col("more").alias("more"), rec.alias("rec"))

        # No column goes through the generator beside the records, or each would be copied for every one.
        no_record = F.lit(None).cast(told.schema["records"].dataType.elementType)
        rows = told.withColumn("more", more).select(F.inline(F.concat(
            F.array(row(no_record, F.col("file"), F.col("kind"), F.col("names"))), F.coalesce(F.transform("records", lambda r: row(r)), F.array()))))
        rows = rows.select("file", "kind", "names", F.col("rec").isNotNull().alias("record"), *[F.col("rec")[n].alias(f"f{k}") for k, n in enumerate(columns)],
                           F.when(F.col("more"), F.map_filter("rec", lambda n, _: ~F.array_contains(known, n))).alias("rest"))
        stored = write_table(rows, shared_path(spark, "json-records"))
        for r in stored.where("kind is not null").groupBy("kind", "names").agg(F.collect_list("file").alias("files")).collect():
            if r["names"] is None:
                kinds.setdefault(r["kind"], []).extend(r["files"])
            else:
                names = {*(names or ()), *r["names"]}
    parts, whole = [], len(kinds) == 1 and names is None
    for kind in sorted({*kinds, *(["keyed"] if names is not None else [])}):
        if kind == "keyed" and names is not None:
            place = {n: F.col(f"f{k}") for k, n in enumerate(columns)}
            parts.append(stored.where("record").select(*[place.get(n, F.col("rest")[n]).alias(n) for n in sorted(names)]))
        if kind in kinds:
            files = sorted(kinds[kind])
            parts.append(_read_layout(spark, _as_given(path, files) if whole else files, kind, records_key, split_over))
    return parts


def _as_given(path, files: list[str]):
    """A source's path in place of all its files, which is listed at once and not
    file by file.  Files in folders named like a column's value are given one by one,
    as that column is no part of their records."""
    return files if any("=" in f.rpartition("/")[0] for f in files) else path


def detect_json_layout(spark: SparkSession, path) -> str:
    """The one layout of a source's files: ``array``, ``lines`` or ``object``
    (also for no files: ``lines``).  Files of several layouts are an error here."""
    kinds = {k if k in ("array", "lines") else "object" for k in detect_json_layouts(spark, path)}
    if len(kinds) > 1:
        raise ValueError(f"files of several JSON layouts: {sorted(kinds)}")
    return kinds.pop() if kinds else "lines"


#: A JSON string, and what stands for it where only a document's structure is looked at.
_STRING, _S = r'"(?:[^"\\]++|\\.)*+"', "\x01"
#: A flat record as it stands before its closing brace, without its strings.
_FLAT = r"\{[^{}\[\]\"]*$"
_SCALARS = rf"(?:\s*{_S}\s*:[^{{}}\[\]\",]*,)*+\s*"
#: What comes before the first record, before any other, and after the last, by layout.
_AROUND = {
    "array": (r"^\s*\[\s*", r"^\s*,\s*", r"^\s*\]\s*$"),
    "wrapped": (rf"^\s*\{{{_SCALARS}{_S}\s*:\s*\[\s*", r"^\s*,\s*", rf"^\s*\](?:\s*,\s*{_S}\s*:[^{{}}\[\]\",]*)*+$"),
    "keyed": (rf"^\s*\{{\s*{_S}\s*:\s*", rf"^\s*,\s*{_S}\s*:\s*", r"^\s*$"),
}


def _large_files(spark: SparkSession, path, over: int) -> tuple[list[str], object]:
    """The files of more than ``over`` bytes, and the others; ``path`` as it is if none is.
    Names and sizes come from the listing; no content is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    large = sorted(r["path"] for r in files.where(F.col("length") > over).collect())
    return large, sorted(r["path"] for r in files.where(F.col("length") <= over).collect()) if large else path


def _split_documents(spark: SparkSession, files: list[str], layout: str, records_key: str | None) -> tuple[DataFrame | None, list[str]]:
    """Records of large documents, each parsed by many tasks, and the files that
    cannot be.

    The text is cut behind every ``}``, which Spark's line reader does inside
    splits, so a document of flat records falls into one piece per record.  That
    it does is checked on all pieces of a file: each must be a flat record
    after a separator, but for one beginning and one end in their places.  A file with
    nested values, braces inside strings or several lists is not cut.
    """
    first, between, last = _AROUND[layout]
    bare = F.regexp_replace("piece", _STRING, _S)
    pieces = (spark.read.option("lineSep", "}").text(files)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                      F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
                      F.octet_length("value").alias("bytes"), F.regexp_replace("value", "^\ufeff", "").alias("piece")))
    kind = (F.when(bare.rlike(first + _FLAT), "first").when(bare.rlike(between + _FLAT), "record")
            .when(bare.rlike(last), "last").when(bare.rlike(r"^\s*$"), "blank").otherwise("other"))
    told = pieces.withColumn("kind", kind)
    # What precedes a record's own brace: separators and names, after the document's brace in the first piece of an object.
    lead = rf'(?:[^{{"]++|{_STRING})*+'
    lead = F.when((F.col("kind") == "first") & F.lit(layout != "array"), F.regexp_extract("piece", rf"^(\s*\{{{lead})", 1)).otherwise(
        F.regexp_extract("piece", f"^({lead})", 1))
    record = F.concat(F.substr("piece", F.length(lead) + 1), F.lit("}"))
    over = F.col("kind").isin("last", "blank")
    facts = told.groupBy("file").agg(
        F.first("size").alias("size"), (F.sum("bytes") + F.count("*")).alias("read"),
        F.min_by("kind", "at").alias("begins"), F.max_by("kind", "at").alias("ends"),
        (F.min(F.when(over, F.col("at"))) > F.max(F.when(~over, F.col("at")))).alias("ordered"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("first", "last", "blank", "other")],
        F.max(F.when(F.col("kind") == "first", F.regexp_extract(lead, rf"({_STRING})\s*:\s*\[\s*$", 1))).alias("key")).collect()
    good = []
    for r in facts:
        # Whether text follows the last brace; a mark of 3 bytes at the beginning is not read.
        more = r["read"] in (r["size"] + 1, r["size"] - 2)
        whole = r["begins"] == "first" and r["first"] == 1 and not r["other"] and r["ordered"]
        if layout == "array":
            whole = whole and more and r["last"] == 1 and not r["blank"]
        elif layout == "keyed":  # the document's own brace closes a blank piece
            whole = whole and r["last"] == 1 + more
        else:
            whole = whole and r["last"] == 1 and r["blank"] == more and r["ends"] == ("blank" if more else "last")
            whole = whole and (records_key is None or json.loads(r["key"]) == records_key)
        if whole:
            good.append(r["file"])
    rest = sorted({r["file"] for r in facts} - set(good))
    if not good:
        return None, rest
    rows = told.where(F.col("file").isin(good) & F.col("kind").isin("first", "record")).select(record.alias("record"))
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys(F.from_json("record", T.MapType(T.StringType(), T.StringType()), {"mode": "FAILFAST"}))))
                   .distinct().collect())
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return rows.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"), rest


def read_json_extract(spark: SparkSession, path: str, layout: str = "auto",
                      records_key: str | None = None, split_over: int = SPLIT_OVER) -> DataFrame:
    """JSON extract in one of four layouts, every value as text.

    * ``array``   top-level array of records.
    * ``wrapped`` object holding a list of records under ``records_key``
                  (default: the list field whose records carry known headers).
    * ``keyed``   object of records (id -> record).
    * ``lines``   one record per line.
    * ``record``  one object that is one record.
    * ``auto``    decide for every file (``detect_json_layouts``).
    JSON Lines are split.  Documents of up to ``split_over`` bytes are parsed one
    file per task; larger ones of flat records by many tasks each (``_split_documents``).
    """
    if layout == "auto":
        parts = _read_auto(spark, path, records_key, split_over)
        if not parts:
            return _json_rows(spark, path, False)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _read_layout(spark, path, layout, records_key, split_over)


def _read_layout(spark: SparkSession, path, layout: str, records_key: str | None, split_over: int) -> DataFrame:
    """Records of files of one layout."""
    if layout == "lines":
        return _json_rows(spark, path, False)
    if layout in _AROUND:
        large, path = _large_files(spark, path, split_over)
        if large:
            rows, rest = _split_documents(spark, large, layout, records_key)
            parts = [rows] if rows is not None else []
            if path + rest:
                parts.append(_read_documents(spark, path + rest, layout, records_key))
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _read_documents(spark, path, layout, records_key)


def _read_documents(spark: SparkSession, path, layout: str, records_key: str | None) -> DataFrame:
    """Records of JSON documents, a file per task."""
    if layout in ("array", "record"):
        return _json_rows(spark, path, True)
    if layout == "wrapped":
        doc = _json_rows(spark, path, True)
        key = _pick_records_key(doc.schema, records_key)
        if key is None:
            raise ValueError("JSON object holds no list of records")
        rows = doc.select(F.explode(F.col(f"`{key}`")).alias("r"))
        if isinstance(doc.schema[key].dataType.elementType, T.StructType):
            return rows.select("r.*")
        return rows.limit(0)  # an empty list: no records
    if layout == "keyed":
        return _records_from_keyed(spark, path)
    raise ValueError(f"unknown JSON layout {layout!r}")


def ingest(spark: SparkSession, source: str, path: str, **kw) -> DataFrame:
    """Source dispatch: ``csv`` or ``json``; anything else is an error."""
    if source in ("csv", "csv_url", "csv_path"):
        return read_csv_extract(spark, path, **kw)
    if source in ("json", "json_path"):
        return read_json_extract(spark, path, **kw)
    raise ValueError("source must be 'csv' or 'json'")
