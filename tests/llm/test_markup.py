"""Pages whose markup once lost text or took too long; each expectation is written by hand."""

import time

import pytest

from ledgerflow.llm.template_html import Page, Template, main_text

CASES = {
    "class of an ancestor": ("<div class='layout has-sidebar'><article><p>Body text</p></article></div>", "Body text"),
    "class of the article": ("<article class='post has-comments'><p>Body</p></article>", "Body"),
    "id with a word in it": ("<article><h2 id='side-effects'>Side effects</h2><p>Body</p></article>", "Side effects\nBody"),
    "style": ("<article style='overflow:hidden'><p>Body</p></article>", "Body"),
    "title": ("<article><p title='a hidden gem'>Body</p></article>", "Body"),
    "data attribute": ("<article><div data-class='sidebar'>Body</div></article>", "Body"),
    "hidden within a line": ("<article><p>a<span hidden>h</span>b</p></article>", "ab"),
    "hidden, never closed": ("<article><p>a<span hidden>h</p><p>b</p></article>", "a\nb"),
    "block in hidden": ("<article><div>a <span hidden>h<div>i</div></span> b</div></article>", "a b"),
    "only article named": ("<div class='sidebar'><article><p>Body</p><div class='ad'>Buy</div></article></div>", "Body"),
    "named article beside": ("<article><p>Body</p></article><article class='related'><p>More and more and more</p></article>", "Body"),
    "two articles": ("<main><article><p>One</p></article><article><p>Second</p></article></main>", "One\nSecond"),
    "named within": ("<article><p>Body</p><div class='x reader-comments'>no</div><div id=ad_slot>no</div><div class=overflow-hidden>yes</div><div class=no-sidebar>too</div></article>", "Body\nyes\ntoo"),
    "noise": ("<article><p>Body</p><aside>no</aside><div class='post comments'>no</div><nav>no</nav></article>", "Body"),
    "quote without end": ("<article><p title=it's>Body</p><p title=\"x>More</p></article>", "Body\nMore"),
    "bound in quotes": ("<article><p title='a > b' data-x=\"<p>\">Body</p></article>", "Body"),
    "script": ("<article><SCRIPT>var t='</p>';</sCript ><p>Body</p></article>", "Body"),
    "script's name in script": ("<article><script>x='</scripty>'</script><p>Body</p></article>", "Body"),
    "comment": ("<article><p>Bo<!-- <p> -->dy</p></article>", "Body"),
    "references": ("<article><p>a &amp;&lt;b&gt; &eacute;</p></article>", "a &<b> é"),
    "less than": ("<article><p>1 < 2 and 3 <4</p></article>", "1 < 2 and 3 <4"),
    "no article": ("<body><nav>menu</nav><div><p>Body one</p><p>Body two</p></div></body>", "Body one\nBody two"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, text = CASES[name]
    assert main_text(Page(html), Template()) == text


@pytest.mark.parametrize("piece", ["<a ", "<a b=\"", "<a b='x\" ", "<script ", "<!", "<a<", "</script ", "<a x=\">\" ", "<script></scriptx ", "<p hidden>", "<span hidden>"])
def test_markup_of_a_megabyte_is_read_in_seconds(piece):
    begun = time.time()
    Page(piece * (300_000 // len(piece)) + "<article><p>Body</p></article>")
    assert time.time() - begun < 10
