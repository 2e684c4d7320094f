"""Canonical JSON against the standard library's."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from corpusgate.functions.canonical import canonical_digest, canonical_json

KIND = "b string, a array<struct<z:boolean,y:int,x:string>>, m map<string,string>, n bigint, Z struct<`é`:string,`e`:array<array<int>>>"
TEXTS = ["", "plain", 'quo"te', "back\\slash", "line\nfeed\r\t\b\f", "".join(map(chr, range(0x21))), "\x7f\x80\x85  é 漢 😀", "\\u0041"]


def test_canonical_json(spark):
    rows = [(t, [(True, i, t), (False, None, None), None], {t: t, "é": "x", "😀": t, "Z": None, "￿": "y"}, None if i % 2 else i, (t, [[1], [], None])) for i, t in enumerate(TEXTS)]
    rows.append((None, None, None, None, None))
    df = spark.createDataFrame(rows, KIND)
    whole = F.struct(*df.columns)
    kind = df.select(whole.alias("w")).schema["w"].dataType
    out = df.select("b", "a", "m", "n", "Z", canonical_json(whole, kind).alias("json"), canonical_digest(whole, kind).alias("digest")).collect()
    for row in out:
        value = {c: row[c] for c in df.columns}
        value["a"] = None if value["a"] is None else [None if x is None else x.asDict() for x in value["a"]]
        value["Z"] = None if value["Z"] is None else value["Z"].asDict()
        wanted = json.dumps(value, sort_keys=True, ensure_ascii=False)
        assert row.json == wanted
        assert row.digest == hashlib.sha256(wanted.encode()).hexdigest()
