"""Lists, tables and headings of a page without an article element."""

from strandline.llm.html_extract import main_text

LONG = ["".join(f"{c}{i % 10}" for i in range(150)) for c in "abc"]
ITEMS = [f"item {i} x" for i in range(6)]


def page(end):
    return f"<html><body>{''.join(f'<p>{t}</p>' for t in LONG)}{end}</body></html>"


def test_list_after_paragraphs_is_whole():
    assert main_text(page("<ul>" + "".join(f"<li>{t}</li>" for t in ITEMS) + "</ul>")).split("\n") == LONG + ITEMS


def test_table_and_headings_are_whole():
    rows = "".join(f"<tr><td>{t}</td><td>yes</td></tr>" for t in ITEMS)
    want = LONG + [x for t in ITEMS for x in (t, "yes")]
    assert main_text(page(f"<table>{rows}</table>")).split("\n") == want
    between = "<h2>Head</h2>" + "".join(f"<ul><li>{t}</li></ul>" for t in ITEMS) + "<h2>End</h2>" + f"<p>{LONG[0]}</p>"
    assert main_text(page(between)).split("\n") == [*LONG, "Head", *ITEMS, "End", LONG[0]]


def test_other_containers_stay_out():
    links = "".join(f"<li><a>{t}</a></li>" for t in ITEMS)
    text = main_text(f"<html><body><div><ul>{links}</ul></div><div>{'<p>x</p>' * 4}</div><div>{''.join(f'<p>{t}</p>' for t in LONG)}</div></body></html>")
    assert text.split("\n")[-3:] == LONG and ITEMS[0] not in text
