from raylattice.operators import nested

KINDS = ("ObjectScatterFit", "DetectorScatterModel", "Acquisitions")
DOC = "calib_id bigint, scan_id bigint, body string, row_key string, blank int"


def docs(spark, bodies):
    return spark.createDataFrame([(i, 1, b, "clash", 3) for i, b in enumerate(bodies)], DOC)


def found(spark, *bodies):
    return sorted(tuple(r) for r in nested.children(docs(spark, bodies), KINDS).collect())


def test_xml_positions_attributes_namespaces_and_what_is_no_element(spark):
    body = """<?xml version="1.0" encoding="utf-8"?><c:Calibration xmlns:c="urn:x"><c:R><c:Globals/><c:Globals>
      <c:DetectorScatterModel P="1"/><c:DetectorScatterModel> </c:DetectorScatterModel><!-- <DetectorScatterModel>9</DetectorScatterModel> -->
      <c:DetectorScatterModel><c:P><![CDATA[2]]></c:P></c:DetectorScatterModel></c:Globals><c:Notes><![CDATA[<ObjectScatterFit A="1"/>]]></c:Notes></c:R></c:Calibration>"""
    assert found(spark, body) == [(0, "DetectorScatterModel", 2, 1), (0, "DetectorScatterModel", 2, 3)]


def test_json_objects_lists_nulls_and_envelopes(spark):
    inner = '{"Scan": {"@Version": 2, "Acquisitions": [{"SID": ""}, null, {"KV": {"Id": 0}}]}}'
    import json

    assert found(spark, inner, json.dumps({"file": "x", "sent": 1, "payload": inner}), '{"A": [{"ObjectScatterModel": [{"ObjectScatterFit": {"A": "1"}}, {"ObjectScatterFit": null}]}]}') == [
        (0, "Acquisitions", 1, 3), (1, "Acquisitions", 1, 3), (2, "ObjectScatterFit", 1, 1),
    ]


def test_broken_null_and_empty(spark):
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa">]><Scan><Acquisitions><S>&a;</S></Acquisitions></Scan>'
    deep = "[" * 100_000
    assert found(spark, None, "", "  ", "<Scan><Acquisitions><S>1</S></Acquisitions>", '{"Scan": {"Acquisitions": [{"S": 1}]', "hello", bomb, deep, "5") == []
    assert nested.children(docs(spark, ["x"]).limit(0), KINDS).count() == 0
    assert found(spark, "<Scan><Acquisitions>" + "<S>1</S>" * 5000 + "</Acquisitions></Scan>") == [(0, "Acquisitions", 1, 1)]


def test_tables_keep_their_links_and_repeats_fold(spark):
    body = '<Scan><Id>s</Id><Acquisitions><SID>5</SID><sid>6</sid><KV><T>1</T></KV><KV><T>2</T></KV></Acquisitions></Scan>'
    df = docs(spark, [body])
    tables = nested.flatten(df.unionAll(df))
    assert set(tables) == {"Scan", "Scan/Acquisitions", "Scan/Acquisitions/KV"}
    parents = {r["row_key"] for r in tables["Scan/Acquisitions"].collect()}
    kv = tables["Scan/Acquisitions/KV"].orderBy("child_no").collect()
    assert [(r["T"], r["parent_no"], r["child_no"]) for r in kv] == [("1", 1, 1), ("2", 1, 2)] and {r["parent_key"] for r in kv} == parents
    row = tables["Scan/Acquisitions"].collect()[0]
    assert (row["SID"], row["sid_2"]) == ("5", "6")


def test_documents_too_deep_are_reported(spark):
    deep = '{"a":' * 60 + '{"ObjectScatterFit": 1}' + "}" * 60
    xml = "<a>" * 60 + "<ObjectScatterFit>1</ObjectScatterFit>" + "</a>" * 60
    fine = "<a>" * 48 + "<ObjectScatterFit>1</ObjectScatterFit>" + "</a>" * 48
    docs = spark.createDataFrame([(1, deep), (2, xml), (3, fine), (4, "[" * 100_000), (5, "<a>"), (6, "{}"), (7, None), (None, "<a>"), (5, "<a>")], "calib_id bigint, body string")
    assert [tuple(r) for r in nested.children(docs, ("ObjectScatterFit",)).collect()] == [(3, "ObjectScatterFit", 1, 1)]
    reasons = {r["calib_id"]: r["reason"] for r in nested.unreadable(docs).collect()}
    assert reasons.keys() == {1, 2, 4, 5, 6} and all("50" in reasons[k] for k in (1, 2, 4)) and reasons[5] == "not well-formed"
