"""Boxes of structured text: cut at their marks where they are plain numbers, parsed otherwise, with the same values."""

import json

from quirework.sources.structured_text import _box_values, read_structured_text
from pyspark.sql import functions as F

NUMBERS = ["0", "-0", "-0.0", "7", "-7.25", "1e3", "2E-2", "0e5", "-0e5", "1E400", "9007199254740993", "1" * 50, "0." + "3" * 40, "00", "01", "+1",
           ".5", "1.", "null", '"3"', "true", "NaN", "Infinity", "[1]", "{}", "", " 4", "4 "]
PLAIN = ["[10,20,30.5,40]", '{"x":1,"y":-2.5,"w":3,"h":4e1}']


def test_cut_boxes_are_as_parsed(spark):
    texts = [*PLAIN, None, "", "junk", "[]", "[1,2,3]", "[1,2,3,4,5]", "[1,2,3,4]\n", "[1,2,3,4]x", "[1,2,3,4", '{"y":1,"x":2,"w":3,"h":4}',
             '{"x":1,"y":2,"w":3}', '{"x":1,"y":2,"w":3,"h":4,"z":5}', '{"x":1,"y":2,"w":3,"h":4}\n', '{"x":1,"x":2,"y":2,"w":3,"h":4}']
    texts += [f"[1,{n},3,4]" for n in NUMBERS] + [f"[{n},2,3,4]" for n in NUMBERS] + [f"[1,2,3,{n}]" for n in NUMBERS]
    texts += [f'{{"x":{n},"y":2,"w":3,"h":4}}' for n in NUMBERS] + [f'{{"x":1,"y":2,"w":3,"h":{n}}}' for n in NUMBERS]
    df = spark.createDataFrame([(t,) for t in texts], "bbox string")
    is_obj = F.col("bbox").startswith("{")
    parsed = (F.when(is_obj, F.from_json("bbox", "x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE")), F.when(~is_obj, F.from_json("bbox", "ARRAY<DOUBLE>")))
    obj, arr = _box_values(F.col("bbox"))
    got = df.select("bbox", obj.alias("o"), arr.alias("a"), parsed[0].alias("po"), parsed[1].alias("pa")).collect()
    # repr tells NaN, infinity and the sign of zero
    assert [r.bbox for r in got if repr((r.o, r.a)) != repr((r.po, r.pa))] == []
    assert got[0].a == [10.0, 20.0, 30.5, 40.0] and tuple(got[1].o) == (1.0, -2.5, 3.0, 40.0)


def test_reader_takes_boxes_without_functions_on_arrays(spark):
    """A box is worked out in a row of its own; as a value of an array's function it was interpreted for every line."""
    lines = [{"text": "a", "bbox": [1, 2, 3, 4]}, {"text": "b", "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}},
             {"spans": [{"text": "c", "bbox": {"h": 4, "w": 3, "y": 2, "x": 1}}, None, {"text": "d", "bbox": [1, 2], "x": 1, "y": 2}]},
             {"text": "e", "bbox": [1, 2], "x": 5, "y": 6, "spans": [{"text": "f", "bbox": [1, 2, 3, 4]}]}, None]
    df = spark.createDataFrame(
        [(1, 0, 100.0, json.dumps([{"type": "text", "lines": lines}]))], "doc_id long, page_number int, page_height double, json string")
    read = read_structured_text(df)
    got = sorted((r.span_id, r.text, r.x0, r.y0, r.x1, r.y1) for r in read.collect())
    assert got == [
        (0, "a", 1.0, 96.0, 3.0, 98.0), (10**6, "b", 1.0, 94.0, 4.0, 98.0), (2 * 10**6 + 1, "c", 1.0, 94.0, 4.0, 98.0),
        (3 * 10**6, "e", 5.0, 82.0, 5 + 12.0 * 0.6, 94.0), (3 * 10**6 + 1, "f", 1.0, 96.0, 3.0, 98.0)]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("RLIKE(") == 2
