"""Images at their placeholders against a version that goes from match to match."""

import random
import re

from quirekit.operators import figures

MARK = re.compile(figures.PLACEHOLDER)


def by_hand(page_no, kind, source, markdown, images):
    urls, seen = [], set()
    for xref, _, width, height, url in sorted(images, key=lambda i: i[1]):
        if width * height >= 200_000 and xref not in seen:
            seen.add(xref)
            urls.append(url)
    text = markdown or ""
    if not urls:
        return text, 0
    matches = [m for m in MARK.finditer(text) if figures.READ_OFF not in text[m.end() : m.end() + 200]]
    if matches:
        out, at, placed = "", 0, 0
        for n, m in enumerate(matches):
            url = urls[n] if n < len(urls) else None
            out += text[at : m.start()] + (f"![Figure {page_no}.{n + 1}]({url})" if url else m[0])
            placed += url is not None
            at = m.end()
        return out + text[at:], placed
    if kind == "visual" or "![" in text or len(source or "") >= 700 or urls[0] is None:
        return text, 0
    return f"{text.rstrip()}\n\n![Figure {page_no}.1]({urls[0]})\n", 1


def test_images_take_their_places(spark):
    rnd = random.Random(9)
    mark = ["==> picture [1 x 2] intentionally omitted <==", "**==>  picture [10 x 20] intentionally omitted <==**"]
    pieces = ["text ", "Start of picture text", "y" * 190, "é\n", "![old](u)", *mark, *mark]
    pages, images = [], []
    for n in range(1, 400):
        text = None if rnd.random() < 0.03 else "".join(rnd.choice(pieces if rnd.random() < 0.8 else pieces[:1]) for _ in range(rnd.randint(0, 8)))
        pages.append((1, n, rnd.choice(["text", "text", "visual", None]), rnd.choice([None, "s", "s" * 699, "s" * 700]), text, "more"))
        places = rnd.sample(range(9), rnd.randint(0, 4))
        images += [(1, n, rnd.choice([1, 2, 3]), p, rnd.choice([500, 10]), 400, rnd.choice([f"u{p}", f"u{p}", None])) for p in places]
    df = spark.createDataFrame(pages, "doc_id int, page_no int, kind string, source string, markdown string, url string")
    im = spark.createDataFrame(images, "doc_id int, page_no int, xref int, ordinal int, width int, height int, url string")
    got = {r["page_no"]: (r["markdown"], r["n_placed"]) for r in figures.embedded(df, im).collect()}
    assert len(got) == len(pages)
    for _, n, kind, source, text, _ in pages:
        own = [i[2:] for i in images if i[1] == n]
        assert got[n] == by_hand(n, kind or "text", source, text, own), (text, own)
    assert figures.embedded(df.limit(0), im).count() == 0 and figures.embedded(df, im.limit(0)).where("n_placed > 0").count() == 0
