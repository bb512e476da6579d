"""Pages that leave out </head> and <body>."""

from lakemill.llm.html_extract import parse, walk


def texts(page):
    return [p for b in walk(parse(page)) for p in b.parts if isinstance(p, str)]


def test_open_head_ends():
    assert texts("<html><head><title>x</title><article><p>text") == ["text"]
    assert texts("<head><meta charset=a><link href=b><script>s</script>\n<p>one<p>two") == ["one", "two"]
    assert texts("<head><title>x</title> bare text <b>bold</b>") == ["bare text bold"]
    assert texts("<head><noscript><img src=a>no</noscript><style>s</style></head><body><p>text") == ["text"]
