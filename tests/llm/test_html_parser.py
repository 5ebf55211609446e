"""The page parser against an independent one, and markup that browsers read otherwise than by the letter."""

import html.parser
import random

import pytest

from glintmark.llm import htmltext, shared

S = "The first sentence of the story, as long as sentences are. A second one follows, with a comma; and a third!"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{S}<svg><g><text>LABEL</text></g></svg></p><p>{S}</p></article>", f"{S}\n{S}"), (f"<article><p>{S}<svg><p>LABEL</p></svg> more</p></article>", f"{S} more"),
        (f"<article><p>{S}<video><source src=x>Your browser does not support video.</video></p></article>", S), (f"<article><p>{S}<object><param name=x>Fallback<div>deep</div></object> end</p></article>", f"{S} end"),
        (f"<article><p>{S} Before<picture><source><img></picture> after</p></article>", f"{S} Before after"), (f"<article><p>{S} Before <input type=hidden>after</p></article>", f"{S} Before after"),
        (f"<article><p>{S} Before <math><mi>x</mi></math>after</p></article>", f"{S} Before after"), (f"<article><p>{S} Before <x-note>in</x-note> after</p></article>", f"{S} Before in after"),
        (f"<article><p>{S} a<script>x</script>b</p></article>", f"{S} ab"), (f"<article><x-card><p>{S}</p><p>{S}</p></x-card></article>", f"{S}\n{S}"),
        ("<form><input><div><p>Short, but all there is here.</p></div><p>And more, at the end.</p><input></form>", "Short, but all there is here.\nAnd more, at the end."),
        (f"<form><div><input name=q></div><div class=page><p>{S}</p></div><div><input><input></div></form>", S), (f"<article><p>{S * 3}</p></article><form><p>Send us a word, please.</p><input></form>", S * 3),
        (f"<article><p>{S}</p></article><section class=comments><p>{S * 9}</p><p>{S * 5}</p></section>", S), (f"<article><p>{S}</p><section class=comments><p>{S * 9}</p></section></article>", S),
        (f"<article><p>{S}</p><div id='comment-12'><p>{S * 4}</p></div><ol class='comment-list'><li>{S * 3}</ol></article>", S), (f"<div class='layout comments-open'><article><p>{S}</p></article></div>", S),
        (f"<article><p>{S * 3}</p><ol><li><a href=a>Smith, A. On trees, 2001.</a><li><a href=b>Jones, B. On leaves, 2004.</a></ol><address>Written in Paris, by the river.</address></article>", f"{S * 3}\nSmith, A. On trees, 2001.\nJones, B. On leaves, 2004.\nWritten in Paris, by the river."),
        (f"<html><head><title>No</title><body><p>{S}</p>", S), (f"<article><p>{S}</p></article><address>Street 1, Town.</address>", S),
    ],
)
def test_markup(page, want):
    assert htmltext.main_text(page) == want


class Plain(html.parser.HTMLParser):
    """Blocks of well-nested pages: text between starts and ends of block elements, nothing of skipped ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.skip = [], "", 0

    def flush(self):
        if x := " ".join(self.text.split()):
            self.out.append(x)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in htmltext.SKIPPED and tag not in htmltext.VOID:
            self.skip += 1
        elif tag == "br" and not self.skip:
            self.text += " "
        elif tag in htmltext.BLOCKS and not self.skip:
            self.flush()

    def handle_endtag(self, tag):
        if tag in htmltext.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in htmltext.BLOCKS and not self.skip:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text += data


def plain_blocks(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.flush()
    return p.out


def test_blocks_of_all_pages(spark, sf_dir):
    n = 0
    for r in shared.table(spark, sf_dir, "pages").collect():
        if r.html and "</html>" in r.html:
            assert [b.text for b in htmltext.blocks(r.html)] == plain_blocks(r.html)
            n += 1
    assert n > 30


def test_blocks_of_random_pages():
    rnd = random.Random(3)
    inline, block, skip = ["b", "a", "x-y", "picture", "label", "time"], ["div", "section", "ul", "article", "blockquote", "h2"], ["svg", "video", "object", "canvas", "select", "template"]

    def part(depth, within=False):
        kind = rnd.random()
        if depth == 0 or kind < 0.3:
            return rnd.choice(["word, ", "a.", " ", "&amp;", "x<br>y", "é\n"])
        inner = "".join(part(depth - 1, within) for _ in range(rnd.randrange(4)))
        name = rnd.choice(inline if kind < 0.6 or within else block if kind < 0.85 else skip)
        return f"<{name} data-x='1>2'>{inner}</{name}>" if name not in skip or not within else inner

    for _ in range(1500):
        page = "".join(part(5) for _ in range(4))
        assert [b.text for b in htmltext.blocks(page)] == plain_blocks(page), page
