"""Enumerations of the data model, as small tables. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: category -> relations (a star marks those that were added later)
RELATIONS = {
    "结构": ("包含", "构成", "定位*", "修饰"),
    "因果-正": ("促进", "激活", "增强", "诱导", "招募", "上调", "介导*", "经由*"),
    "因果-负": ("抑制", "衰减", "下调", "减弱", "阻断"),
    "证据": ("测量", "提示", "支持", "反驳", "总结*"),
    "时序": ("依赖于*", "先于", "随后"),
    "应用": ("设计策略*", "插入*", "突变*", "替换*"),
}
CLUSTERS = ("mechanism", "application", "conclusion")
POLARITIES = ("promote", "inhibit", "neutral")
ORIGINS = ("sentence", "structural", "inferred")
VIEW_TYPES = ("concept-map", "flow", "domain", "matrix")
KINDS = ("plain", "itam", "brs", "prs", "linker", "costim", "kinase", "mutant", "sp", "scfv", "insert", "signal")
MARKS = ("same", "up", "down", "none", "na")
PAYLOADS = ("sections", "graph", "notebook", "annotations")


def relations(spark: SparkSession) -> DataFrame:
    rows = [(r.rstrip("*"), category, r.endswith("*")) for category, names in RELATIONS.items() for r in names]
    return spark.createDataFrame(rows, "rel string, category string, new boolean")
