"""File contents made from the tables: source code, documents, manifests, schemas, diffs.

A sample's path and content are templates over a row's columns, as one SQL expression that Spark and the oracle both read. So parsers run
over as many files as a table has rows, and what they must find follows from the columns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

_COLUMN = re.compile(r"<([a-z]_\w+|\w+\(.*?\))>")


def sql(template: str) -> str:
    """'text' || CAST(column AS STRING) || ... of a template with <column> in it. No quotes or backslashes in the text."""
    parts = _COLUMN.split(template)
    return " || ".join(f"CAST({p} AS STRING)" if i % 2 else f"'{p}'" for i, p in enumerate(parts) if p)


#: name: (table, path, content)
SAMPLES: dict[str, tuple[str, str, str]] = {
    "python": (
        "supplier",
        "scm/n<s_nationkey>/supplier_<s_suppkey>.py",
        """import os
from nation_<s_nationkey> import Nation
from ..shared import tools

class Supplier<s_suppkey>(Nation):
    \"\"\"Supplies parts to nation <s_nationkey>. Keyed by number.\"\"\"

def call_<s_suppkey>(amount: int, rate: float = 0.5) -> str:
    \"\"\"Calls supplier <s_suppkey> now. More text.\"\"\"
    # return the amount
    return str(amount)
""",
    ),
    "typescript": (
        "part",
        "parts/b<substr(p_brand, 7)>/part_<p_partkey>.ts",
        """import { Brand } from "./brand"
import React from "react"
import { x } from "@scope/kit/deep"
export interface Part<p_partkey> { size: number }
export class Item<p_partkey> extends Base {}
export function price<p_partkey>(x: number): string { return "" }
""",
    ),
    "markdown": (
        "customer",
        "docs/customer_<c_custkey>.md",
        """# Customer <c_custkey>

Buys in the <c_mktsegment> segment
of nation <c_nationkey> and pays well.

## Orders

```python
x = 1
```

### Recent

See [nation](./nation_<c_nationkey>.md#top).

## Contact
""",
    ),
    "rst": (
        "nation",
        "docs/nation_<n_nationkey>.rst",
        """<n_name>
========

Lies in region <n_regionkey>.

Trade
-----

Much of it.
""",
    ),
    "package": (
        "nation",
        "nations/nation_<n_nationkey>/package.json",
        """{"name": "nation_<n_nationkey>", "version": "1.<n_nationkey>.0", "dependencies": {"region_<n_regionkey>": "^1.<n_regionkey>"},
 "devDependencies": {"jest": "~29"}, "scripts": {"build": "make <n_nationkey>"}}
""",
    ),
    "compose": (
        "region",
        "regions/region_<r_regionkey>/docker-compose.yml",
        """version: 3
services:
  web:
    image: web:<r_regionkey>
    depends_on:
      - db
  db:
    image: store
volumes:
  data:
""",
    ),
    "openapi": (
        "region",
        "regions/region_<r_regionkey>/openapi.json",
        """{"openapi": "3.0", "info": {"title": "Region <r_name>", "version": "<r_regionkey>"},
 "paths": {"/nations": {"get": {"summary": "Nations of <r_name>", "responses": {"200": {"content": {"application/json":
  {"schema": {"$ref": "#/components/schemas/Nation<r_regionkey>"}}}}}}}},
 "components": {"schemas": {"Nation<r_regionkey>": {"properties": {"id": {"type": "integer"}, "name": {"type": "string"}}, "required": ["id"]}}}}
""",
    ),
    "prisma": (
        "region",
        "regions/region_<r_regionkey>/schema.prisma",
        """model Region<r_regionkey> {
  id     Int
  name   String?
  nations Nation<r_regionkey>[]
}
model Nation<r_regionkey> {
  id  Int
}
enum Kind {
  OLD
  NEW
}
""",
    ),
    "graphql": (
        "region",
        "regions/region_<r_regionkey>/schema.graphql",
        """# comment
type Region<r_regionkey> {
  id: ID!
  name: String
}
type Query {
  region<r_regionkey>(id: ID!): Region<r_regionkey>
}
enum Kind {
  OLD
  NEW
}
""",
    ),
    "proto": (
        "region",
        "regions/region_<r_regionkey>/trade.proto",
        """package trade;
service Trade<r_regionkey> {
  rpc Ship (Order) returns (Receipt);
}
message Order {
  int64 id = 1;
}
""",
    ),
    "env": ("region", "regions/region_<r_regionkey>/.env", "REGION_KEY=<r_regionkey>\n# note\nDB_URL = x\nab=1\n"),
    "dockerfile": ("region", "regions/region_<r_regionkey>/Dockerfile", "FROM base:<r_regionkey>\nRUN x\nEXPOSE 80<r_regionkey>\n"),
    "pyproject": (
        "region",
        "regions/region_<r_regionkey>/pyproject.toml",
        """[project]
name = "region_<r_regionkey>"
version = "0.<r_regionkey>"
dependencies = ["flask>=2", "lib_<r_regionkey>==1.0"]
""",
    ),
    "diff": (
        "nation",
        "nation_<n_nationkey>",
        """diff --git a/src/x b/src/x
--- a/src/<if(n_nationkey % 3 = 0, 'test_x.py', if(n_nationkey % 3 = 1, 'settings.py', 'x.py'))>
+++ b/src/<if(n_nationkey % 3 = 0, 'test_x.py', if(n_nationkey % 3 = 1, 'settings.py', 'x.py'))>
@@ -1,2 +1,3 @@ def sell_<n_nationkey>():
+import mod_<n_nationkey>
+from lib_<n_regionkey> import a, b
-import gone
""",
    ),
    "generated": (
        "part",
        "gen/<if(p_partkey % 8 = 0, 'yarn.lock', if(p_partkey % 8 = 1, 'a.min.js', if(p_partkey % 8 = 2, 'x_pb2.py', if(p_partkey % 8 = 3, 'y.d.ts', 'm.py'))))>",
        "<if(p_partkey % 8 = 4, '# Generated by a tool', if(p_partkey % 8 = 5, '// eslint-disable', if(p_partkey % 8 = 6, 'x = 1 # generated by hand', 'text @Generated')))>\n",
    ),
}


def files(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """path, content of the samples of these names."""
    each = [table(spark, sf_dir, SAMPLES[n][0]).select(F.expr(sql(SAMPLES[n][1])).alias("path"), F.expr(sql(SAMPLES[n][2])).alias("content")) for n in names]
    return reduce(DataFrame.unionByName, each)


def path_sql(name: str) -> str:
    """The path as an expression, for oracles."""
    return f"({sql(SAMPLES[name][1])})"
