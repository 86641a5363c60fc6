"""Queries of the flows that ask a model, each with a scripted client whose answers SQL can tell."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire.functions import adapter
from quire.operators import flows
from quire.plans.base import Plans, load

plans = Plans()


def _beginning(prompt: str) -> str:
    """The first 20 characters of the text, twice."""
    text = prompt.split("\n\n", 2)[2][:20]
    return json.dumps({"items": [{"text": t, "type": "术语"} for t in (text, text.upper() if text.isupper() else text)]})


def _plain(prompt: str) -> str:
    """A translation; none of a word of an odd length."""
    word = prompt.split("## Selected\n")[1].split("\n\n## Sentence\n")[0]
    return json.dumps({"sentenceZh": "S", "termZh": "不完整" if len(word) % 2 else "T"}, ensure_ascii=False)


def _second(prompt: str) -> str:
    """A poor lead at first where the title ends in 1."""
    poor = "turned down" not in prompt and prompt.split("\n")[0].endswith("1")
    return json.dumps({"titleZh": "z", "lead": {"gist": "g" * (10 if poor else 30), "focus": ["a", "b"]}, "views": ["v"]})


for _name, _client in (("beginning", _beginning), ("plain", _plain), ("second", _second)):
    adapter.register(f"quire-{_name}", _client)


def _turns(spark, d):
    t = load(spark, d, "conversations")
    return t.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("section_id"), F.col("role").alias("title"), F.col("turn").alias("first_page"), F.col("turn").alias("last_page"), "text")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@plans.add("ann_01_annotated", f"SELECT concat_ws('-', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS section_id, {_STRIP.format('left(text, 20)')} AS text FROM conversations WHERE length({_STRIP.format('left(text, 20)')}) >= 3")
def _(spark, d):
    return flows.annotate(_turns(spark, d), "quire-beginning")[0].select("section_id", "text")


_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_TRN = f"""WITH r AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, split_part(text, ' ', 1) AS w, text FROM conversations),
k AS (SELECT *, {_KEY.format("w")} AS kw, {_KEY.format("text")} AS ks FROM r),
s AS (SELECT DISTINCT ks FROM k WHERE turn = 0 AND ks <> ''), t AS (SELECT DISTINCT kw, ks FROM k WHERE turn = 0 AND conv_id % 2 = 0 AND kw <> '' AND ks <> '')
SELECT id, hit AS cached, CASE WHEN hit THEN 'cached sentence' ELSE 'S' END AS sentence_zh, CASE WHEN hit THEN 'cached term' WHEN length(w) % 2 = 1 THEN '不完整' ELSE 'T' END AS term_zh, NOT hit AND length(w) % 2 = 1 AS refused
FROM (SELECT k.*, s.ks IS NOT NULL AND t.ks IS NOT NULL AS hit FROM k LEFT JOIN s ON s.ks = k.ks LEFT JOIN t ON t.ks = k.ks AND t.kw = k.kw)"""


@plans.add("trn_01_translated", _TRN)
def _(spark, d):
    c = load(spark, d, "conversations").withColumn("w", F.substring_index("text", " ", 1))
    first = c.where("turn = 0")
    # a word with a stroke would stand for two
    terms = first.where("conv_id % 2 = 0").select(F.replace("w", F.lit("/"), F.lit("")).alias("term"), F.col("text").alias("example"), F.lit("cached term").alias("zh"))
    requests = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("w").alias("text"), F.col("text").alias("sentence"))
    return flows.translate(requests, first.select(F.col("text").alias("en"), F.lit("cached sentence").alias("zh")), terms, "quire-plain")[0]


@plans.add("anl_01_extracted", "SELECT concat_ws('-', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS section_id, CASE WHEN turn = 1 THEN 2 ELSE 1 END AS attempt FROM conversations WHERE text IS NOT NULL")
def _(spark, d):
    turns = _turns(spark, d).withColumn("title", F.concat_ws(" ", "title", F.when(F.col("first_page") == 1, "1").otherwise("0")))
    return flows.extract(turns, None, "quire-second")[0].select("section_id", "attempt")
