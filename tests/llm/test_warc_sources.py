"""WARC records as they are found: repeated headers, codings, letters that grow in lower case."""

import gzip
import zlib

from lodeframe.llm import warc


def response(head, body):
    block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body
    return warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>"), ("WARC-Target-URI", "http://x/")], block)


def derived(raw):
    headers, block = next(warc.parse(raw))
    return [next(warc.parse(d["record"]))[1].decode() for d in warc.derive(headers, block)]


def test_letters_that_grow_in_lower_case():
    assert warc.extract("İ" * 20 + "<script>x</script>visible text here")[1] == "İ" * 20 + "visible text here"
    assert warc.extract("a<SCRIPT>x</ScRiPt>b<style>never closed")[1] == "ab"


def test_all_headers_are_kept():
    meta, _ = derived(response("Set-Cookie: a=1\r\nX-Odd: one\r\n two\r\nset-cookie: b=2\r\nServer: s", b"<p>t"))
    assert [x for x in meta.split("\r\n") if x.startswith("source-header-")] == [
        "source-header-set-cookie: a=1", "source-header-x-odd: one two", "source-header-set-cookie: b=2", "source-header-server: s",
    ]


def test_codings():
    page = "<p>Grüße".encode()
    chunked = b"".join(b"%x;e=1\r\n%s\r\n" % (len(page[i : i + 3]), page[i : i + 3]) for i in range(0, len(page), 3)) + b"0\r\n\r\n"
    for head, body in (
        ("Transfer-Encoding: chunked", chunked),
        ("Content-Encoding: gzip", gzip.compress(page)),
        ("Content-Encoding: deflate", zlib.compress(page)),
        ("Content-Encoding: gzip", page),  # not what it says
        ("Transfer-Encoding: chunked", page),
    ):
        meta, text = derived(response(head, body))
        assert text == "Grüße" and f"source-payload-digest: {warc.digest(body)}" in meta


def test_members_one_by_one():
    records = [warc.response(i, f"http://x/{i}", "<p>" + "long " * 500_000) for i in range(3)]
    raw = b"".join(map(gzip.compress, records))
    assert list(warc.members(raw)) == records
    assert [warc.named(h)["warc-target-uri"] for h, _ in warc.parse(raw)] == ["http://x/0", "http://x/1", "http://x/2"]


def test_bodies_that_are_no_text_have_no_conversion():
    (meta,) = derived(response("Content-Type: image/png", bytes(range(256)) * 4))
    assert "conversion: none, for image/png is no text" in meta
    assert len(derived(response("Content-Type: application/xhtml+xml", b"<p>t"))) == len(derived(response("X: y", b"<p>t"))) == 2


def test_all_members_of_a_body_and_no_bombs(monkeypatch):
    body = gzip.compress(b"<p>one ") + gzip.compress(b"two")
    assert derived(response("Content-Encoding: gzip", body))[1] == "one two"
    assert derived(response("Content-Encoding: gzip", body + b"rest"))[1] == "one two"
    monkeypatch.setattr(warc, "MOST_UNPACKED", 1000)
    assert warc.decoded(gzip.compress(b"x" * 1000), {"content-encoding": "gzip"}) == b"x" * 1000
    bomb = gzip.compress(b"x" * 500) + gzip.compress(b"x" * 501)
    assert warc.decoded(bomb, {"content-encoding": "gzip"}) == bomb


def test_charsets():
    for head, body in (
        ("Content-Type: text/html", b"<meta charset='iso-8859-1'><p>caf\xe9"), ("Content-Type: text/html; charset=latin1", b"<p>caf\xe9"),
        ("Content-Type: text/html", b"<p>caf\xe9"), ("Content-Type: text/html", "<p>caf\u00e9".encode("utf-16")),
        ("Content-Type: text/html; charset=nonsense", "<p>caf\u00e9".encode()), ("X: y", b'<meta http-equiv=x content="text/html; charset=utf-8"><p>caf\xc3\xa9'),
    ):
        assert derived(response(head, body))[1] == "caf\u00e9"


def test_versions_stay_and_damage_is_counted(spark, tmp_path):
    old = warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:o>")], b"HTTP/1.1 200 OK\r\n\r\n<p>t", "WARC/1.0")
    whole = gzip.compress(old)
    files = {"a": old + b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx", "b": whole + whole[:-9], "c": b"", "d": old[:-10], "e": old}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = warc.read_warc(spark, str(tmp_path))
    got = sorted((r["path"][-1], r["record"] is not None, r["damage"] is not None) for r in rows.collect())
    assert got == [("a", False, True), ("a", True, False), ("b", False, True), ("b", True, False), ("d", False, True), ("e", True, False)]
    made = warc.derivatives(rows, "path").collect()
    assert len(made) == 6 and all(bytes(r["record"]).startswith(b"WARC/1.0\r\n") for r in made)
