"""Texts for the tests, written for them: two regular sonnets and pieces that break one rule each."""

FIELD = """<SONNET>
Nel campo verde canta il mio fratello,
la sera porta il vento sopra il mare,
la luna bianca torna a illuminare
la strada lunga verso il mio castello.

Sul ramo secco posa un grande uccello,
il sole basso smette di brillare,
la gente buona torna a riposare
e il fuoco scalda il tavolino bello.

La madre conta i passi della festa,
il padre porta il pane dal mercato,
la bimba mette un fiore sulla testa;

il nonno dorme sotto il pino alzato,
la nonna prega, fuori c'è tempesta,
e il giorno stanco scende sopra il prato.
"""

INN = """<SONNET>
«Chi viene?», dice l'oste sulla porta,
«la notte è scura e il lupo s'avvicina!»
Risponde il frate: «L'anima mia è morta,
ma l'oro brilla ancora giù in cantina.»

L’oste sospira, la candela è corta,
s’affaccia al muro, guarda la collina,
e dice piano: «Il vino ci conforta,
bevi, compare, fino a domattina.»

Passa la luna, passa anche la pena,
il frate canta, l'oste batte il piede,
l'acqua del fosso luccica serena.

Chi beve l'ombra solo l'ombra vede,
chi mangia il pane lascia il sonno in cena,
e a chi racconta il vero non si crede.
"""

SCRAP = """
Arrivò il messo, e il messo non parlava,
portava un libro
dove ognuno di noi poteva leggere a lungo il proprio nome scritto con l'inchiostro
"""

#: An octave that rhymes, a sestet on one rhyme only, lines far too short.
ONE_RHYME = """Torna il grano
sotto la neve
la sera beve
dentro la mano

suona lontano
passo che deve
farsi più breve
verso quel piano

chiude la porta
dorme la torta
lampada corta

foglia contorta
vela già morta
vita risorta"""

REGULAR = "q\nw\ne\nr\n\nt\ny\nu\ni\n\no\np\na\n\ns\nd\nf"
SHORT_FIRST = "q\nw\ne\n\nt\ny\nu\ni\n\no\np\na\n\ns\nd\nf"

TAGGED = """<SONNET>
Apre la riva
passa la nave
grave soave
l'ombra è cattiva

<STANZA>
Nuota la trota
<END>"""

UNTAGGED = """apre la riva
passa la nave
era una trave
l'ombra è cattiva

l'alba che arriva
gira la chiave
voce soave
fiamma furtiva

nuota la trota
passa la vela
gira la ruota

fila la tela
piange la nota
resta la mela"""

DIRTY = "Päne… [nota] (34) “sera”\xa0tardi"

ALL = {"field": FIELD, "inn": INN, "scrap": SCRAP, "one_rhyme": ONE_RHYME, "regular": REGULAR, "short_first": SHORT_FIRST, "tagged": TAGGED, "untagged": UNTAGGED, "dirty": DIRTY}

#: Words and the rhyme suffix that each rule gives: accent, two vowels, one vowel, none, punctuation.
SUFFIXES = [("Fiorisce?!", "isce"), ("Disegnar!", "egnar"), ("O", "o"), ("Bontà;", "à"), ("cantor", "antor"), ("sapore...", "ore"), ("nymphs", "phs"), ("cartella", "ella")]
