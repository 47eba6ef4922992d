"""Extractors on fixed strings with expectations written by hand."""

from cinegrain.markup import core, lists, tables

TABLE = """{| class="wikitable"
|+ Caption
! Year !! Title !! scope="col" | Role
|-
| rowspan="2" style="x" | 1999 || ''[[Alpha]]'' || A1
|-
| Beta ||
|-
| colspan="2" | X || Y
|}"""


def test_parameters():
    assert core.parameters("a|B=c [[x|y]]|3=z|w||q={{t|u=v}}|b=d") == {"1": "a", "b": "d", "3": "z", "4": "w", "q": "{{t|u=v}}"}


def test_infobox_and_templates():
    text = "{{Short description|x}}{{Infobox film\n| name = A<ref>{{cite|title=b}}</ref>\n| starring = {{ubl|[[B|b]]|c}}\n}}"
    assert core.infobox(text)["starring"] == "{{ubl|[[B|b]]|c}}"
    assert [t["name"] for t in core.templates(text, ".")] == ["Short description", "Infobox film", "cite", "ubl"]
    assert core.infobox("{{Infobox film | a = b") is None and core.infobox(None) is None


def test_plain():
    assert core.plain("A ''b'' '''c''' {{INR|5}} {{nowrap|n}} {{x|{{y}}}}[[File:q.jpg|t]] a < 5<br>d<ref>r</ref>\nnext\n\n== H ==\np &amp; q") == "A b c ₹5 n a < 5 d next\nH\np & q"
    # A paired reference swallows what lies between an earlier self-closing one and itself.
    assert core.plain('a<ref name="x"/> lost <ref>y</ref> b') == "a b"
    assert core.plain(None) == ""


def test_lists_and_sections():
    assert core.list_items("{{plainlist|\n* [[A]]\n* B, C\n}}") == ["A", "B, C"] and core.list_items("A<br />B") == ["A", "B"] and core.list_items("") == []
    found = core.sections("lead\n==Plot==\nbody\n=== Sub ===\nmore")
    assert [(s["title"], s["level"], s["body"]) for s in found] == [("Plot", 2, "body"), ("Sub", 3, "more")]
    assert core.plot_section("== Story ==\ns\n== Plot ==\np") == "p"


def test_tables():
    view = tables.read_table(TABLE)
    assert view["header"] == ["year", "title", "role"]
    assert view["rows"] == [["1999", "''[[Alpha]]''", "A1"], ["1999", "Beta", ""], ["X", "X", "Y"]]


def test_filmography():
    rows = lists.filmography("== Filmography ==\n=== Film ===\n" + TABLE + "\n* [[Gamma (film)|Gamma]]\n=== Reception ===\n[[No]]")
    assert [(r["year"], r["title"], r["wikititle"]) for r in rows][:3] == [("1999", "Alpha", "Alpha"), ("1999", "Beta", None), (None, "Gamma", "Gamma (film)")] or rows[0]["medium"] == "film"


def test_cast():
    rows = lists.cast("== Cast ==\n* [[A B]] as C\n** and D\n* E F as G<ref/>\n* [[H|I]] – J,\nnoise")
    assert [(r["name"], r["wikititle"], r["role"]) for r in rows] == [("A B", "A B", "C and D"), ("E F", None, "G"), ("I", "H", "J")]


def test_awards():
    rows = lists.awards("== Awards ==\n{|\n! Year !! Award !! Category !! Film !! Result\n|-\n| rowspan=2|2001 || Big Award || Best || ''[[Z]]'' || {{won}}\n|-\n| Small || Worst || Y || {{nom}}\n|}\n* 2003 – [[Prize]] for ''[[Q]]''")
    assert [(r["year"], r["award"], r["work"], r["result"]) for r in rows] == [("2001", "Big Award", "Z", "won"), ("2001", "Small", "Y", "nominated"), ("2003", "Prize", "Q", "won")]
    assert lists.award_totals({"wins": "3", "award1": "A", "award1w": "2", "award3": "B"})["ceremonies"][1]["award"] == "B"


def test_references():
    text = '<ref name=a/> x<ref name="A">{{cite web|title=T|url=http://u/x|website=W}}</ref><ref>[http://www.h.com/p]</ref><ref>plain</ref><ref name=a />'
    assert [(r["label"], r["url"], r["source"]) for r in core.references(text)] == [("T", "http://u/x", "W"), ("h.com", "http://www.h.com/p", None), ("plain", None, None)]


def test_tracks_episodes_discography():
    found = lists.soundtrack("== Soundtrack ==\n{{Track listing|title1=A|note1=S|all_lyrics=L|title2=B}}")
    assert [(t["title"], t["singers"], t["lyrics"]) for t in found["tracks"]] == [("A", "S", "L"), ("B", None, "L")]
    assert lists.episodes("== Season 2 ==\n{{Episode list|EpisodeNumber=1|Title=T|ShortSummary=s}}")[0]["season"] == 2
    songs = lists.discography('== Songs ==\n{|\n! Year !! Film !! Song !! Singer(s)\n|-\n| rowspan=2|2000 || F || "One" || P\n|-\n| G || Two || Q\n|}')
    assert [(s["year"], s["film"], s["song"]) for s in songs] == [("2000", "F", "One"), ("2000", "G", "Two")]


def test_links_and_html():
    assert core.wiki_links("[[A|b]] [[A]] [[File:x]] [[C#d]]") == [{"target": "A", "label": "b"}, {"target": "C", "label": "C#d"}]
    assert core.linked_html("a [[X|y]] & [[Z]] [[File:Q]] \"", {"X": "/x"}) == 'a <a href="/x">y</a> &amp; Z &quot;'
    assert core.date_text("{{Birth date and age|1984|5|31|df=y}}") == "31 May 1984"
    assert lists.subpage("{{Main| P filmography }}", "filmography") == "P filmography"
    assert core.external_links("{{IMDb title|tt0012345}}\n* [https://a.b Label]") == {"imdbid": "0012345", "official": None, "links": [{"label": "Label", "url": "https://a.b"}]}
