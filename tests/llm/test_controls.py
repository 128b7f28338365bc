"""Pages with controls, closed details and dialogs."""

from tidelane.llm import html


def test_controls_and_escapable_text():
    assert html.render("<textarea>abc &amp; d</textarea><button>go") == "abc & d go"
    assert html.render("a<button>b</button>c") == "a b c"
    assert html.render("<p>x<textarea>  two\nlines </textarea>y") == "x two lines y"
    assert html.render("<textarea>a <b>b</b> &lt;i&gt;</textarea>") == "a <b>b</b> <i>"
    assert html.render("<svg><title>a &amp; b</title><text>t</text></svg>") == "t"


def test_closed_details_show_their_summary():
    assert html.render("<details>before<summary>More <b>here</b></summary>hidden<p>too</details>after") == "More here\nafter"
    assert html.render("<details open><summary>More</summary>seen</details>after") == "More\nseen\nafter"
    assert html.render("<details><p>no summary</details>x") == "x"
    assert html.render("<details><summary>a</summary><summary>b</summary></details>") == "a"
    assert html.render("a<dialog>no</dialog>b<dialog open>yes</dialog>") == "a\nb\nyes" or html.render("a<dialog>no</dialog>b<dialog open>yes</dialog>") == "ab\nyes"
