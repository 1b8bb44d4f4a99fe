"""Source files written from table rows, one file per row.

The text is a SQL expression over the row's columns, so that files are made by
Spark where the rows are, and no group of rows is ever gathered.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from factgraph.functions.skew import spread_small
from factgraph.sources.tables import table
from factgraph.sources.tree import as_files

# {x} is a SQL expression over the row
JAVA_LINES = """package shop.c{o_custkey};

import java.util.List;
import static shop.Prices.*;

/**
 * Order {o_orderkey}
 * of customer {o_custkey}.
 */
public class O{o_orderkey} extends Base{o_custkey} implements Priced {
    private List<Long> lines = load();

    public O{o_orderkey}(long total) {
        super(check(total));
        this.total = total;
    }

    @Override
    public long price{o_orderkey}(int qty, String... notes) {
        // note("not a call") {
        if (qty > 0) {
            log("status: {o_orderstatus}; (x");
            {CASE WHEN o_orderstatus = 'F' THEN 'return total;' ELSE 'audit.check(new Entry(qty));' END}
        }
        return helper.scale(total, price{o_orderkey}(qty));
    }
}
"""

PYTHON_LINES = '''"""Line {l_orderkey} {l_linenumber}."""
import os, math as m
from . import base

class Line(base.Row):
    """Part {l_partkey}."""

    def __init__(self, qty={CAST(l_quantity AS INT)}):
        self.qty = qty

    @property
    def total(self):
        if self.qty > {l_linenumber}:
            return price(load({l_suppkey}))
        for x in self.rows():
            keep(x)
        {CASE WHEN l_returnflag = 'R' THEN 'return refund(self.qty)' ELSE 'self.close()' END}

def main():
    Line().total()
'''


def text_sql(template: str) -> str:
    """The template as one SQL string expression."""
    parts = []
    for i, piece in enumerate(re.split(r"\{([^{}\n]*[A-Za-z_][^{}\n]*)\}", template)):
        if i % 2:
            parts.append(f"CAST({piece} AS STRING)")
        elif piece:
            rows = [f"'{row}'" for row in piece.replace("'", "''").split("\n")]
            parts.append(" || chr(10) || ".join(rows))
    return " || ".join(parts)


JAVA_TEXT, PYTHON_TEXT = text_sql(JAVA_LINES), text_sql(PYTHON_LINES)
JAVA_PATH = "'gen/O' || o_orderkey || '.java'"
PYTHON_PATH = "'gen/l' || l_orderkey || '_' || l_linenumber || '.py'"


def _files(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    # the short rows are spread, not the texts made of them
    return as_files(spread_small(rows, key).selectExpr(f"{path} AS filepath", f"{text} AS content"))


def java_files(spark: SparkSession, folder: str) -> DataFrame:
    return _files(table(spark, folder, "orders"), "o_orderkey", JAVA_PATH, JAVA_TEXT)


def java_files_after(spark: SparkSession, folder: str) -> DataFrame:
    """The same tree later: pending orders are gone, finished ones rewritten."""
    after = table(spark, folder, "orders").where("o_orderstatus <> 'P'")
    text = f"CASE WHEN o_orderstatus = 'F' THEN replace({JAVA_TEXT}, 'helper.scale', 'helper.round') ELSE {JAVA_TEXT} END"
    return _files(after, "o_orderkey", JAVA_PATH, text)


def python_files(spark: SparkSession, folder: str) -> DataFrame:
    return _files(table(spark, folder, "lineitem"), "l_orderkey", PYTHON_PATH, PYTHON_TEXT)
