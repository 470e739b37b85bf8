"""plain paths to attributes, without Spark's parser for each document, against Spark's `xpath`."""

import pytest
from pyspark.sql import functions as F
from tessera.sources import xmltable

DOCS = [
    '<order><line part="1" qty="25.0"/><line part="2" qty="26"/><line qty="30"/><line part="4"/></order>',
    '<order><line part="5" qty=" 30 "/><line part="6" qty="1E5"/><x part="7" qty="-.5" k="v"/><line part="a&lt;é" qty="+3" k="v"/></order>',
    '<order xmlns="urn:p"><line part="1" qty="30"/></order>',
    '<order xmlns:p="urn:p"><p:line part="1" qty="40"/><line p:part="2" part="3" qty="40"/></order>',
    '<order><order><line part="8" qty="99"/></order><line part="9" qty="nan"/><line part="9" qty=""/></order>',
    '<?xml version="1.0" encoding="UTF-16"?><order><!-- a --><line part="10" qty="50"/><line part="" k="v"/></order>',
    '<!DOCTYPE order [<!ENTITY e "11">]><order><line part="&e;" qty="27"/></order>',
    '<order><p:line part="1" qty="40"/><line p:part="2" xml:part="4" part="3" qty="40"/></order>',
    "<other/>",
    "",
    None,
]
PATHS = ["order/line[@qty>25]/@part", "/order/line[1]/@part", "/order/*[@k='v'][1]/@part", "order/line[2][@qty>=26]/@part", "*/line[@qty!=26]/@part", 'order/*[@k!="w"]/@qty', "order/line[@qty<0.5]/@part", "order/line[@k=-1]/@part", "order/@part", "order/order/line/@qty"]


@pytest.mark.parametrize("path", PATHS)
def test_attributes(spark, path):
    assert xmltable.attributes(path)
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "i int, doc string")
    got = xmltable.values(df, "doc", path).withColumn("want", F.xpath("doc", F.lit(path))).orderBy("i").collect()
    assert [r.found for r in got] == [r.want for r in got]


@pytest.mark.parametrize("path", ["//line/@part", "order/line/text()", "order/line[last()]/@part", "order/line[@a and @b]/@part", "p:order/@part", "order/line[@qty>'2']/@part", "order/line[0]/@part", "order/../order/@part", "@part", "order/line[position()<2]/@part"])
def test_other_paths_are_left_to_spark(path):
    assert xmltable.attributes(path) is None


def test_malformed_documents_fail_as_before(spark):
    df = spark.createDataFrame([("<a><b id='1'></a>",)], "doc string")
    with pytest.raises(Exception, match="must be terminated"):
        xmltable.values(df, "doc", "a/b/@id").collect()


def test_several_paths_at_once(spark):
    paths = {"a": PATHS[0], "b": "//line/@part", "c": PATHS[2]}
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "i int, doc string")
    got = xmltable.values_at(df, "doc", paths).withColumns({f"want_{o}": F.xpath("doc", F.lit(p)) for o, p in paths.items()}).collect()
    assert all(r[o] == r[f"want_{o}"] for r in got for o in paths)
