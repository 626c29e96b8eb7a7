import io
import json

import pytest

from lodestone.functions.text import parse_size
from lodestone.sources import extractors as x
from lodestone.sources import inputs as i


def test_classify(tmp_path):
    odd = tmp_path / "a[1].txt"
    odd.write_text("x")
    assert [i.classify(s) for s in ("-", "HTTPS://h/x", "https://h/r.git", str(odd), str(tmp_path / "*.txt"), "gone.txt")] == ["stdin", "url", "git", "local", "glob", "local"]


@pytest.mark.parametrize("given,want", [("HTTP://EXAMPLE.com:80/a?b=1#c", "http://example.com/a?b=1"), ("https://h:443", "https://h/"), ("https://h:444/x", "https://h:444/x")])
def test_normalize_url(given, want):
    assert i.normalize_url(given) == want


@pytest.mark.parametrize("bad", ["ftp://h/x", "http://u:p@h/", "http://"])
def test_bad_urls(bad):
    with pytest.raises(i.InputError):
        i.normalize_url(bad)


def test_public_ip():
    closed = "127.0.0.1 10.1.1.1 169.254.1.1 100.64.0.1 192.0.2.1 224.0.0.1 0.1.2.3 ::1 fe80::1 ::ffff:10.0.0.1 2001:db8::1 2002::1 2001::1 3fff::1".split()
    assert not any(map(i.public_ip, closed))
    assert all(map(i.public_ip, ("8.8.8.8", "2606:4700::1111", "::ffff:8.8.8.8")))


def test_stdin_and_globs(tmp_path):
    root = i.prepare("-", stdin=io.BytesIO(b"hello"))
    assert root.identity.startswith("stdin://sha256/") and root.items[0].content == b"hello"
    with pytest.raises(i.InputError, match="size_limit"):
        i.prepare("-", most=3, stdin=io.BytesIO(b"hello"))
    with pytest.raises(i.InputError):
        i.expand(str(tmp_path / "none*"))


def test_checked_lines(tmp_path):
    import hashlib

    p = tmp_path / "l"
    p.write_bytes(b"a\nb\n")
    assert list(i.checked_lines(str(p), hashlib.sha256(b"a\nb\n").hexdigest())) == [b"a", b"b"]
    with pytest.raises(i.InputError):
        list(i.checked_lines(str(p), "0" * 64))


def test_decode():
    assert x.decode("é".encode()) == "é" and x.decode(b"\xef\xbb\xbfa") == "a" and x.decode("hi".encode("utf-16")) == "hi" and x.decode(b"caf\xe9 au lait") == "café au lait"
    for bad in (b"a\0b", b"\x01" * 2 + b"a" * 100):
        with pytest.raises(i.InputError):
            x.decode(bad)
    assert x.decode(b"\x01" + b"a" * 99)


def test_html():
    text, title = x.html_text("<html><head><title>T</title></head><body><nav>n</nav><main>one <b>two</b><script>s</script><p hidden>h</p></main></body></html>")
    assert (text, title) == ("one\ntwo\n", "T")
    assert x.html_text("<p>plain</p><article>a</article><article>longer</article>")[0] == "longer\n"


def test_notebook():
    book = {"cells": [{"cell_type": "heading", "source": "no"}, {"cell_type": "code", "source": ["print(", "1)"], "outputs": [{"data": "img"}]}, {"cell_type": "markdown", "source": "é"}]}
    text, meta = x.notebook_text(json.dumps(book))
    assert text == "print(1)\n\né\n\n"
    assert meta["cells"] == [{"cell": 1, "byte_start": 0, "byte_end": 8}, {"cell": 2, "byte_start": 10, "byte_end": 12}]


def test_pdf_pages():
    text, meta = x.pdf_pages("Hello\f\f日本語\f", 3, lambda n: "Français")
    assert text == "Hello\fFrançais\f日本語\f"
    raw = text.encode()
    assert [raw[p["byte_start"] : p["byte_end"]].decode() for p in meta["pages"]] == ["Hello", "Français", "日本語"]
    assert [p["ocr"] for p in meta["pages"]] == [False, True, False]
    for args in (("a\fb\f", 3, None), (" \f", 1, None)):
        with pytest.raises(i.InputError):
            x.pdf_pages(*args)
    assert x.page_count("Title: x\nPages:   12\n") == 12
    with pytest.raises(i.InputError):
        x.page_count("Pages: 0")


def test_dispatch():
    assert x.extract(b"# hi", "md").media_type == "text/markdown"
    for data, code in ((b"PK\x03\x04", "unsupported"), (b"\x1f\x8b", "unsupported")):
        with pytest.raises(i.InputError, match=code):
            x.extract(data, "bin")
    assert x.extract(b"abc", "foo", {"foo": ["cat", "{path}"]}).text == "abc"
    with pytest.raises(i.InputError, match="missing_extractor"):
        x.extract(b"abc", "foo", {"foo": ["no-such-program", "{path}"]})
    with pytest.raises(i.InputError, match="extractor_timeout"):
        x.run_bounded(["sleep", "5"], timeout=0.2)


def test_parse_size():
    assert [parse_size(s) for s in ("10", "1KB", "2KiB", "64 MiB")] == [10, 1024, 2048, 64 << 20]
    for bad in ("0", "1TB", "x"):
        with pytest.raises(ValueError):
            parse_size(bad)


def test_ensure_file(tmp_path):
    import hashlib

    answers = [OSError("down"), b"bad", b"good"]

    def get(url, most):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return i.Item(url, content=a)

    want, at = hashlib.sha256(b"good").hexdigest(), str(tmp_path / "f")
    assert open(i.ensure_file("https://h/f", at, want, get=get), "rb").read() == b"good"
    assert i.ensure_file("https://h/f", at, want, get=get) == at and not answers
    answers[:] = [b"bad"] * 3
    with pytest.raises(i.InputError):
        i.ensure_file("https://h/f", str(tmp_path / "g"), want, get=get)
    assert not (tmp_path / "g").exists()
