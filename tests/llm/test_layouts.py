"""Layouts written by hand, in four languages: footers and headers inside articles, readers' comments by name and by form alone, articles that
are lists, tables as layout, names in other languages. Each with the text that is to come out."""

import random

import pytest

from lamina.llm import main_text as m

EN = "<p>The council met on Tuesday to talk about the bridge, which has been shut since March.</p><p>Members heard from two engineers, and from people who live near by.</p><p>No date was set for the work.</p>"
EN_TEXT = "The council met on Tuesday to talk about the bridge, which has been shut since March.\n\nMembers heard from two engineers, and from people who live near by.\n\nNo date was set for the work."
DE = "<p>Der Rat hat am Dienstag über die Brücke beraten, die seit März gesperrt ist.</p><p>Zwei Ingenieure kamen zu Wort, dazu einige Anwohner.</p>"
DE_TEXT = "Der Rat hat am Dienstag über die Brücke beraten, die seit März gesperrt ist.\n\nZwei Ingenieure kamen zu Wort, dazu einige Anwohner."
FR = "<p>Le conseil s'est réuni mardi pour parler du pont, fermé depuis le mois de mars.</p><p>Deux ingénieurs ont pris la parole, puis des habitants du quartier.</p>"
FR_TEXT = "Le conseil s'est réuni mardi pour parler du pont, fermé depuis le mois de mars.\n\nDeux ingénieurs ont pris la parole, puis des habitants du quartier."
ES = "<p>El consejo se reunió el martes para hablar del puente, cerrado desde marzo.</p><p>Hablaron dos ingenieros y algunos vecinos del barrio.</p>"
ES_TEXT = "El consejo se reunió el martes para hablar del puente, cerrado desde marzo.\n\nHablaron dos ingenieros y algunos vecinos del barrio."


def whole(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul></nav>"
FOOT = "<footer>&copy; The paper, all rights kept.</footer>"
ITEMS = ["Ten walks along the river in spring","How to mend a coat in an evening","Where the old mills of the town stood","What to plant before the first frost","A short guide to the city's bridges","Five soups that cost next to nothing","Why the harbour clock runs late","The best benches to read a book on"]
LIST = "<ol>"+"".join(f"<li><a href='/{i}'>{t}</a></li>" for i,t in enumerate(ITEMS))+"</ol>"
LIST_TEXT = "\n\n".join(ITEMS)
LAYOUTS = [
    (whole(f"{MENU}<article><h1>Bridge stays shut</h1>{EN}<footer>Filed under: news</footer></article>{FOOT}"), "Bridge stays shut\n\n"+EN_TEXT),
    (whole(f"{MENU}<main><h1>Brücke bleibt zu</h1>{DE}<section class='kommentare'><h3>Kommentare</h3><p>Das wird noch Jahre dauern.</p><p>Wer soll das bezahlen?</p></section></main>{FOOT}"), "Brücke bleibt zu\n\n"+DE_TEXT),
    (whole(f"{MENU}<article><h1>Our best of the year</h1>{LIST}</article>{FOOT}"), "Our best of the year\n\n"+LIST_TEXT),
    (whole(f"<table><tr><td><a href='/'>Home</a> <a href='/n'>News</a></td><td><h1>Bridge stays shut</h1>{EN}</td></tr></table>"), "Bridge stays shut\n\n"+EN_TEXT),
    (whole(f"<header><h2>Le journal</h2></header><div class='contenu'><h1>Le pont reste fermé</h1>{FR}</div><div class='commentaires'><p><b>Anne</b></p><p>Encore des mois à attendre.</p><p><b>Luc</b></p><p>C'est une honte, vraiment.</p></div><div class='pied-de-page'>Mentions légales</div>"), "Le pont reste fermé\n\n"+FR_TEXT),
    (whole(f"<div class='menú'><ul><li><a href='/'>Inicio</a></li><li><a href='/n'>Noticias</a></li></ul></div><main class='noticia'><h1>El puente sigue cerrado</h1>{ES}<div class='publicidad'>Compre ahora, es barato.</div></main><div class='aviso-cookies'>Usamos cookies en este sitio.</div>"), "El puente sigue cerrado\n\n"+ES_TEXT),
    (whole(f"<div class='hauptmenü'><a href='/'>Start</a> <a href='/n'>Nachrichten</a></div><article class='beitrag'><h1>Brücke bleibt zu</h1>{DE}</article><aside class='seitenleiste'><h3>Mehr dazu</h3><ul><li><a href='/1'>Stau am Ring</a></li><li><a href='/2'>Neue Fähre</a></li></ul></aside><div class='impressum'>Impressum</div>"), "Brücke bleibt zu\n\n"+DE_TEXT),
    (whole(f"{MENU}<article><header><h1>Bridge stays shut</h1></header>{EN}</article>{FOOT}"), "Bridge stays shut\n\n"+EN_TEXT),
    (whole(f"<table><tr><td colspan=2><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/s'>Sport</a></td></tr><tr><td>{EN}</td><td><a href='/1'>One</a><br><a href='/2'>Two</a></td></tr><tr><td colspan=2>&copy; The paper</td></tr></table>"), EN_TEXT),
    (whole(f"{MENU}<article><h1>Bridge stays shut</h1>{EN}</article><div><div class='item'><p><b>Anna</b> <time>12 March</time></p><p>At last someone says it.</p></div><div class='item'><p><b>Ben</b> <time>13 March</time></p><p>I doubt it will help.</p></div><div class='item'><p><b>Carl</b> <time>13 March</time></p><p>Same here, sadly.</p></div></div>{FOOT}"), "Bridge stays shut\n\n"+EN_TEXT),
    (whole(f"<div class='wrap'><div class='brand'>The Paper</div>{MENU}<div class='story'><h1>Bridge stays shut</h1>{EN}<div class='share'><ul><li><a>Mail</a></li><li><a>Print</a></li></ul></div></div></div>"), "Bridge stays shut\n\n"+EN_TEXT),
    (whole(f"<article>{DE}<footer><p>Von der Redaktion, am Dienstag</p></footer></article>"), DE_TEXT),
    (whole(f"{MENU}<main><article><h1>Le pont reste fermé</h1>{FR}<ul><li>Début des travaux en juin, selon la mairie.</li><li>Une navette gratuite relie les deux rives.</li></ul></article><div class='connexes'><a href='/1'>La gare</a> <a href='/2'>Le port</a></div></main>{FOOT}"), "Le pont reste fermé\n\n"+FR_TEXT+"\n\nDébut des travaux en juin, selon la mairie.\n\nUne navette gratuite relie les deux rives."),
    (whole(f"<div id='cookie-hinweis'>Wir verwenden Cookies.<button>OK</button></div><div class='inhalt'><h1>Brücke bleibt zu</h1>{DE}<table><tr><th>Jahr</th><th>Kosten</th></tr><tr><td>2019</td><td>drei Millionen</td></tr></table></div>"), "Brücke bleibt zu\n\n"+DE_TEXT+"\n\nJahr\n\nKosten\n\n2019\n\ndrei Millionen"),
    (whole(f"<form class='buscar'><input name=q><button>Buscar</button></form><article><h1>El puente sigue cerrado</h1>{ES}</article><ol class='comentarios'><li><p>Ya era hora de decirlo.</p></li><li><p>No lo creo, la verdad.</p></li></ol>"), "El puente sigue cerrado\n\n"+ES_TEXT),
    (whole(f"{MENU}<div class='post'><h2>Bridge stays shut</h2>{EN}<blockquote><p>We have waited long enough, said one of them.</p></blockquote></div><div class='newsletter'><p>Get our letter each week.</p></div>{FOOT}"), "Bridge stays shut\n\n"+EN_TEXT+"\n\nWe have waited long enough, said one of them."),
    (whole(f"{MENU}<main><h1>How to get here</h1><p>Take the train to the old station, then walk.</p><ol><li><p>Leave by the north door.</p></li><li><p>Cross the square and turn left at the well.</p></li></ol></main>{FOOT}"), "How to get here\n\nTake the train to the old station, then walk.\n\nLeave by the north door.\n\nCross the square and turn left at the well."),
    (whole(f"<div class='page'><div class='entête'><p>Le journal</p></div><div class='texte'>{FR}</div><div class='partager'><ul><li><a>Courriel</a></li><li><a>Imprimer</a></li></ul></div></div>"), FR_TEXT),
    (whole(f"{MENU}<section><h1>Bridge stays shut</h1>{EN}</section><section class='replies'><h3>2 replies</h3><p>I was there and it was dull.</p><p>Then why go at all?</p></section>"), "Bridge stays shut\n\n"+EN_TEXT),
    (whole(f"<aside><h3>Lo más leído</h3><ol><li><a href='/1'>El puerto</a></li><li><a href='/2'>La plaza</a></li></ol></aside><div class='cuerpo'><h1>El puente sigue cerrado</h1>{ES}</div>"), "El puente sigue cerrado\n\n"+ES_TEXT),
    (whole(f"{MENU}<article><h1>Was wir lesen</h1><ul>{''.join(f'<li><a href=/{i}>{t}</a>, schon jetzt ein Lieblingsbuch der Redaktion.</li>' for i,t in enumerate(['Der lange Weg nach Hause','Ein Sommer am See','Die Uhr im Turm','Vom Kochen mit Resten']))}</ul></article>{FOOT}"), "Was wir lesen\n\n"+"\n\n".join(f"{t}, schon jetzt ein Lieblingsbuch der Redaktion." for t in ['Der lange Weg nach Hause','Ein Sommer am See','Die Uhr im Turm','Vom Kochen mit Resten'])),
    (whole(f"<center><table width=600><tr><td bgcolor=gray><a href='/'>Accueil</a><br><a href='/n'>Nouvelles</a><br><a href='/c'>Contact</a></td><td>{FR}</td></tr></table></center>"), FR_TEXT),
    (whole(f"{MENU}<article><h1>Bridge stays shut</h1>{EN}<div class='kommentar'><b>Uwe</b><p>Na endlich.</p></div><div class='kommentar'><b>Ina</b><p>Das glaube ich nicht.</p></div></article>{FOOT}"), "Bridge stays shut\n\n"+EN_TEXT),
    (whole(f"{MENU}<main><h1>El puente sigue cerrado</h1>{ES}</main><footer><p>Aviso legal</p><ul><li><a href='/c'>Contacto</a></li></ul></footer>"), "El puente sigue cerrado\n\n"+ES_TEXT),
]


@pytest.mark.parametrize("number", range(len(LAYOUTS)))
def test_layout(number):
    source, want = LAYOUTS[number]
    assert m.extract_all([source], m.trained())[0] == want


def test_names_with_accents():
    assert [m.parse(f"<div class='{c}'>x</div>").tokens[1] for c in ("menú", "hauptmenü", "entête")] == [m.parse(f"<div class='{c}'>x</div>").tokens[1] for c in ("menu", "hauptmenu", "entete")]


def test_null_and_repeated_pages(spark):
    source, want = LAYOUTS[0]
    rows = [(None, "u", source), (7, None, source), (7, None, source), (8, "u", None)]
    got = m.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=str) == sorted([(None, "u", want, len(want)), (7, None, want, len(want)), (7, None, want, len(want)), (8, "u", "", 0)], key=str)


def test_a_page_of_random_tags_is_read():
    rng = random.Random(1)
    for _ in range(50):
        page = "".join(rng.choice(("<p>", "</p>", "<li>", "<table><tr><td>", "</table>", "<time>", "</time>", "words, some. ", "<a href=x>", "</a>", "<footer>", "</article>", "&copy;", "<")) for _ in range(80))
        assert isinstance(m.extract_all([page], m.trained())[0], str)
