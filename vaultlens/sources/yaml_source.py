"""YAML documents as tables: a batch source ``format("vault_yaml")`` and a writer.

    spark.dataSource.register(YamlSource)
    spark.read.format("vault_yaml").schema(SCHEMA).option("list", "true").load("/hosts/*/backup.yml")

Each file is one row (or with ``list`` one row for each element, with its place in column pos). Columns
``host`` (the folder's name) and ``pos`` are filled if the schema has them and the document doesn't. Booleans are true and false
only, so a host named ``no`` stays a name. A missing file gives no rows, an empty one gives
option ``default`` (JSON). Needs PyYAML.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, Row, StringType, StructType


def load(content: str):
    """SRC-01, SRC-02: a document under YAML 1.2's core booleans."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {c: [(tag, rx) for tag, rx in found if tag != "tag:yaml.org,2002:bool"] for c, found in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    import re

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return yaml.load(content, Loader)


def typed(value, kind: DataType):
    """A loaded value in a column's type; dates become milliseconds, misfits null."""
    if isinstance(value, datetime.datetime):
        value = (value if value.tzinfo else value.replace(tzinfo=datetime.timezone.utc)).timestamp() * 1000
    if value is None:
        return None
    if isinstance(kind, StructType):
        return Row(**{f.name: typed(value.get(f.name), f.dataType) for f in kind}) if isinstance(value, dict) else None
    if isinstance(kind, ArrayType):
        return [typed(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, MapType):
        return {str(k): typed(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, (LongType, IntegerType)):
        return int(value) if isinstance(value, (int, float)) and value == value else None
    if isinstance(kind, DoubleType):
        return float(value) if isinstance(value, (int, float)) else None
    return value if isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list)) else str(value)


class YamlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault_yaml"

    def reader(self, schema: StructType) -> DataSourceReader:
        return YamlReader(schema, self.options)


class YamlReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.rows, self.default = options.get("list", "false") == "true", options.get("default")

    def partitions(self) -> list[InputPartition]:
        import glob

        files = sorted(glob.glob(self.path))
        return [InputPartition(files[low : low + 200]) for low in range(0, len(files), 200)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            with open(path) as f:
                document = load(f.read()) or (json.loads(self.default) if self.default else None)
            host = os.path.basename(os.path.dirname(path))
            for pos, item in enumerate(document or [] if self.rows else [] if document is None else [document]):
                item = item if isinstance(item, dict) else {"value": item, "host": item}
                item = {"host": host, "pos": pos} | item
                yield tuple(typed(item.get(f.name), f.dataType) for f in self.schema)


def from_text(df: DataFrame, schema: str) -> DataFrame:
    """The same for documents that lie in a column: path, value -> path, document. For stores that only Spark reads (read.text, wholetext)."""
    kind = StructType.fromDDL(schema)

    @F.udf(kind)
    def parse(value: str):
        return typed(load(value or ""), kind)

    return df.select("path", parse("value").alias("document"))


def compact(value):
    """FLT-09, SNK-01: a value without nulls: keys of an object and elements of an array; objects inside objects keep theirs."""
    if isinstance(value, list):
        return [compact(v) for v in value if v is not None]
    if isinstance(value, dict):
        return {k: v for k, v in value.items() if v is not None}
    return value


def write(rows: DataFrame, path: str) -> None:
    """SNK-01: a small table as one YAML list; written beside and moved into place. Catalogue files are small: a row for each backup of a host."""
    import yaml

    made = [compact(r.asDict(recursive=True)) for r in rows.toLocalIterator()]
    with open(f"{path}.tmp", "w") as f:
        yaml.safe_dump(made, f, sort_keys=False)
    os.replace(f"{path}.tmp", path)
