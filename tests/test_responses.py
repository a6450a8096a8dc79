from saldo.sources import captures, responses as R

TEXT = "<ENVELOPE>Größe ØÜ 𝄞 ₹</ENVELOPE>"


def decoded(spark, content, kind=None):
    df = spark.createDataFrame([(bytearray(content), kind)], "content binary, content_type string")
    return R.decode_responses(df).first()["text"]


def test_encodings(spark):
    assert decoded(spark, TEXT.encode("utf-8")) == TEXT
    assert decoded(spark, TEXT.encode("utf-16")) == TEXT
    assert decoded(spark, b"\xfe\xff" + TEXT.encode("utf-16-be")) == TEXT
    assert decoded(spark, TEXT.encode("utf-16-le")) == TEXT
    assert decoded(spark, TEXT.encode("utf-16-be")) == TEXT
    assert decoded(spark, "<ENVELOPE>é</ENVELOPE>".encode("latin-1"), "text/xml; charset=ISO-8859-1") == "<ENVELOPE>é</ENVELOPE>"
    assert decoded(spark, b"<ENVELOPE>\xff</ENVELOPE>") == "<ENVELOPE>�</ENVELOPE>"


def test_malformed_utf16_does_not_fail(spark):
    broken = "<ENVELOPE>x".encode("utf-16-le") + b"\x00\xd8" + "</ENVELOPE>".encode("utf-16-le")
    assert "\x00" in decoded(spark, broken)
    assert decoded(spark, b"\xff\xfe" + "<ENVELOPE>".encode("utf-16-le") + b"x") is not None
    long = "<ENVELOPE>" + "Øß𝄞" * 200_000 + "</ENVELOPE>"
    assert decoded(spark, long.encode("utf-16")) == long


def test_clean(spark):
    df = spark.createDataFrame([("a\x00\x1f\tb&#4;&#9;&#010;&#x1F;&#xA;&#32;&#031;\x7f",)], "text string")
    assert R.clean_responses(df).first()["text"] == "a\tb&#9;&#010;&#xA;&#32;"


def request(body):
    return b"POST / HTTP/1.1\r\nHost: a\r\n\r\n" + body


def test_captures(spark):
    wide = lambda t: t.encode("utf-16-le")
    one = wide("<ENVELOPE><HEADER><TYPE>Collection</TYPE><ID>X</ID></HEADER><COLLECTION NAME=\"c\"><TYPE>TaxUnit</TYPE><FETCH>A, B</FETCH><COMPUTE> P: $Q </COMPUTE></COLLECTION></ENVELOPE>")
    blob = b"\xd4\xc3" + request(one + b"\x00\xd8\x01") + request(wide("no xml")) + b"POST / HTTP/1.1 cut" + request("<ENVELOPE><TYPE>Ünï</TYPE></ENVELOPE>".encode())
    df = spark.createDataFrame([("p", bytearray(blob))], "path string, content binary")
    found = captures.describe_requests(captures.extract_envelopes(df)).orderBy("seq").collect()
    assert [(r["seq"], r["type"], r["id"], r["object_type"], r["fetch"], r["compute"]) for r in found] == [
        (1, "Collection", "X", "TaxUnit", ["A", "B"], ["P: $Q"]), (2, "Ünï", None, None, [], []),
    ]
    assert found[0]["envelope"].endswith("</ENVELOPE>")
