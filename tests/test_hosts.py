import pytest

from loomaudit.functions.hosts import ascii_host
from loomaudit.functions.urls import parse_url


@pytest.mark.parametrize(
    ("text", "host"),
    [
        ("Example.COM", "example.com"),
        ("faß.de", "xn--fa-hia.de"),
        ("FAẞ.de", "xn--fa-hia.de"),
        ("βόλος.gr", "xn--nxasmm1c.gr"),
        ("www。ｅｘａｍｐｌｅ．com｡", "www.example.com."),
        ("bücher.example", "xn--bcher-kva.example"),
        ("bücher.example", "xn--bcher-kva.example"),
        ("BÜCHER.example", "xn--bcher-kva.example"),
        ("a­b.c", "ab.c"),
        ("日本語.jp", "xn--wgv71a119e.jp"),
        ("क्‍ष.in", "xn--11b2ezcw70k.in"),
        ("xn--fa-hia.de", "xn--fa-hia.de"),
        ("XN--FA-HIA.de", "xn--fa-hia.de"),
        ("ⅷ.com", "viii.com"),
        ("exa%6Dple.com", "example.com"),
        ("fa%C3%9F.de", "xn--fa-hia.de"),
        ("אבג.com", "xn--4dbcd.com"),
        ("a_b.example", "a_b.example"),
        ("-a-.example", "-a-.example"),
    ],
)
def test_hosts(text, host):
    assert ascii_host(text) == host


@pytest.mark.parametrize("text", ["", "a b.com", "a‍b.com", "̈a.com", "xn--a", "xn--zzzzzz-.com", "xn--example-.com", "a<b", "a%2Fb", "a%00b", "­", "אa.com", "1א.com", "a.com", "a:b", "xn--ls8h=.com"])
def test_no_hosts(text):
    assert ascii_host(text) is None


def test_urls_use_them():
    assert parse_url("https://Straße.example/ä?ö#ü")[:5] == ("https", "xn--strae-oqa.example", "", "https://xn--strae-oqa.example", "/%C3%A4")
    assert parse_url("https://a‍b.example/") is None
