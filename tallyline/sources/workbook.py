"""Export tables as one workbook, a sheet each.

A workbook is one file for one reader, so it is put together on the driver, a row at a time; a table beyond a sheet's own
limit is refused, and goes to CSV or Parquet instead.
"""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a sheet, the heading among them, and characters of a cell.
ROWS, CHARS = 1 << 20, 32_767
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def flat(df: DataFrame) -> DataFrame:
    """df with maps as columns of their own, by their keys, and other nested values as JSON text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            keys = [r[0] for r in df.select(F.explode(F.map_keys(f.name))).distinct().orderBy(F.col("col")).collect()]  # headers of a sheet
            out += [F.element_at(f.name, F.lit(k)).alias(k) for k in keys]
        else:
            out.append(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f.name))
    return df.select(*out)


def _cell(at: str, value: object) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{at}"><v>{value}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))[:CHARS]  # what a sheet can hold
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(df: DataFrame) -> Iterator[str]:
    yield f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'
    columns = [_letters(i) for i in range(len(df.columns))]
    row = lambda n, values: f'<row r="{n}">' + "".join(_cell(f"{c}{n}", v) for c, v in zip(columns, values, strict=True)) + "</row>"
    yield row(1, df.columns)
    for n, r in enumerate(df.toLocalIterator(), 2):
        if n > ROWS:
            raise ValueError(f"More than {ROWS - 1} rows do not fit a sheet: write CSV or Parquet instead.")
        yield row(n, r)
    yield "</sheetData></worksheet>"


def write_workbook(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Writes the tables to `path`, in whatever file system it names, as a workbook with a sheet for each."""
    names = [re.sub(r"[\[\]:*?/\\]", " ", name)[:31] for name in tables]
    with tempfile.TemporaryFile() as local:  # the driver's own; the whole file then goes to its place
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
            z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            sheets = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="s{i}"/>' for i, name in enumerate(names, 1))
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheets>{sheets}</sheets></workbook>')
            links = "".join(f'<Relationship Id="s{i}" Type="{_LINK}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
            for i, df in enumerate(tables.values(), 1):
                with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                    for text in _sheet(flat(df)):
                        out.write(text.encode())
        local.seek(0)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        while chunk := local.read(1 << 20):
            stream.write(bytearray(chunk))
        stream.close()
