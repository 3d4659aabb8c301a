"""A data source for structure files by identifier, backed by a folder that mirrors the service.

    spark.dataSource.register(StructureSource)
    spark.read.format("structures").option("mirror", folder).option("ids", "1abc,2xyz").load()
"""

from __future__ import annotations

import os
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Wanted(InputPartition):
    def __init__(self, ids):
        self.ids = ids


class StructureSource(DataSource):
    """Rows (pid, kind, found, text). An unknown identifier is a row with found = false."""

    @classmethod
    def name(cls):
        return "structures"

    def schema(self):
        return "pid string, kind string, found boolean, text string"

    def reader(self, schema):
        return StructureReader(self.options)


class StructureReader(DataSourceReader):
    def __init__(self, options):
        self.mirror, self.kind = options["mirror"], options.get("kind", "cif")
        ids = [re.sub(r"(?i)\.(cif|pdb|ent)$", "", x.strip()).upper() for x in options.get("ids", "").split(",") if x.strip()]
        self.ids, self.size = ids, int(options.get("perTask", "64"))

    def partitions(self):
        return [Wanted(self.ids[i : i + self.size]) for i in range(0, len(self.ids), self.size)] or [Wanted([])]

    def read(self, partition):
        for pid in partition.ids:
            path = os.path.join(self.mirror, f"{pid}.{self.kind}")
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    yield pid, self.kind, True, f.read()
            else:
                yield pid, self.kind, False, None
