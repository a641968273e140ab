"""Rules of sentence ends as tables over kinds of tokens, compiled once into what the transducer reads.

A mark that may end a sentence is described by six kinds: what stands before it, the mark,
what closes behind it, the gap, what follows, and whether letter case tells anything. The
rules below say for each combination whether the mark ends nothing, ends a sentence, or
ends one if no quotation or bracket around it goes on. They are written as conditions over
kinds and compiled to a table of all combinations; running them is a look-up.

Words are told apart by closed lists: abbreviations by how they behave, and function words
(articles, pronouns, prepositions, conjunctions, auxiliaries), which hint at a beginning or
a continuation where case doesn't.
"""

from __future__ import annotations

from itertools import product

# Abbreviations without their last point, lower-cased, by language.
#: Something always follows: titles, ranks, places, "for example".
LEADING = set(
    # en
    "dr mr mrs ms mx prof rev hon gen col maj capt cmdr lt sgt cpl pvt adm brig cdr sen rep gov pres supt det insp amb atty messrs mt ft st ste vs viz cf approx ca e.g i.e resp "
    # de
    "hr hrn frl dipl ing mag vgl bzw siehe evtl ggf inkl exkl zzgl sog z.b d.h u.a u.ä i.d.r o.ä s.o s.u v.a m.e i.a z.t "
    # fr
    "m mm mme mmes mlle mgr me pr c.-à-d p.ex env av bd "
    # es
    "dra sra srta sres dña lic arq gral cnel cap tte sto sta mons p.ej "
    # ru
    "см ср напр им ул г-н г-жа доц акад проф просп т.е т.к т.н "
    # el
    "π.χ δηλ βλ κ κα κος δρ καθ "
    # hi, ar, th
    "डॉ प्रो श्री श्रीमती पं د أ م ดร นาย นาง".split()
)
#: Before a number only; otherwise words like others.
NUMBERED = set(
    "no nos nr fig figs abb tab eq eqs sec secs ch chap vol vols art arts pp p pag pág págs s rev ver v núm num kap bd ed ex lfg ziff abs "
    "jan feb mar apr jun jul aug sep sept oct okt nov dec dez ene abr ago dic janv févr avr juil déc "
    "рис табл гл п пп с т стр ст д кв εικ σελ αρ πιν план".split()
)
#: May end a sentence; what follows decides. First those after which a name may stand as well as a sentence.
MIDDLE = set("al usw usf т.д т.п др пр κ.λπ κ.ά κτλ inc ltd co corp jr sr bros u.dgl".split())
#: Names of places that begin longer names as well.
NAMED = set("u.s u.k e.u u.n u.s.a d.c n.y l.a ee.uu с.ш.а".split())
CLOCK = set("a.m p.m".split())
TRAILING = MIDDLE | NAMED | CLOCK | set(
    "etc ff f est dept univ assn ave blvd rd wash calif mass conn ill mich minn penn tenn tex va ph.d m.d b.a b.sc m.sc n.chr v.chr ud uds c.v "
    "г гг в вв тыс млн млрд руб коп".split()
)
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez".split())
#: File endings and the like, which follow a point without being a sentence.
ENDINGS = set("log yaml yml json jsonl txt csv tsv md py js toml ini cfg xml html htm pdf png jpg gif parquet npz zip gz tar sh sql ipynb com org net edu gov io".split())

# Function words by language.
JOINING = set("and or but nor then yet und oder et ou y o и или και ή".split())
HELPING = set("was were is are be been has have had will would can could may might must shall should".split())
LINKING = set(
    "for with without on in at as by against beyond only whenever while because inside outside between until till despite once during across when where that than "
    "under over above below long before after since through throughout within towards upon per via if although though unless whereas to from into onto off about around among along like near "
    "mit ohne bei für gegen seit während weil dass obwohl avec sans pour par con sin para por".split()
)
SAYING = set("said wrote says asks asked added adds replied noted notes answered explained argued claimed schrieb sagte fragte meinte note nota dit ajoute anota dijo añadió écrit écrivit отметили отметил сказал сказала сказали написал написали".split())
#: Past forms of irregular verbs that differ from the present: with "-ed" they show that a sentence goes on behind a name.
PAST = set(
    "arose ate awoke beat became began bent bit bled blew bound bred broke brought built burnt bought came caught chose clung crept dealt drank drew drove dug dwelt fed fell felt "
    "fled flew forbade forgave forgot fought found froze gave got grew ground heard held hid hung kept knelt knew laid lay leant leapt learnt led left lent lit lost made meant met mistook "
    "overcame overtook overwrote paid proved ran rang rebuilt redid rewrote rode rose said sang sank sat saw sent sewed shone shook shot shrank slept slid slung "
    "sold sought spent spoke sprang spun stood stole stopped stuck stung strode strove struck swam swept swore swung taught thought threw told took tore understood undertook went "
    "wept withdrew withheld withstood woke won wore wound wove wrote".split()
)
#: Articles, pronouns, question words and the like, with which sentences begin.
STARTING_BY_LANGUAGE = {
    "en": "the a an it's it he she they we you i this that these those there here someone somebody everyone everybody anyone nobody none neither no every each some many most all both few several another such "
    "what why who whom whose which how when where did does do is are was were can could should would will may might must has have had let then so however therefore thus hence moreover meanwhile instead "
    "otherwise perhaps finally also not nothing everything something its his her their our my your of on in at by for from once while if as after before during since until with without under over",
    "de": "der die das dem den des ein eine einer einem er sie es wir ihr ich man dies diese dieser dieses jede jeder warum wer wie was wann wo wohin nach bei am im vor seit zu zum zur mit ohne auf aus",
    "fr": "le la les l' un une des il elle ils elles nous vous je on ce cet cette ces pourquoi quel quelle quels quelles qui que quand où comment après avant avec sans pour par dans sur au aux chez",
    "es": "el los las lo una unos unas él ella ellos ellas nosotros yo este esta estos estas ese esa aquel según tras qué quién cuándo dónde cómo por para con sin en al del",
    "ru": "в на по после до за из от при с у о к для почему кто что где когда как зачем он она оно они мы вы я это этот эта эти тот та те весь вся все",
    "el": "ο η το οι τα του της των ένας μια ένα γιατί ποιος πώς πότε πού τι μετά πριν στην στη στο στον με για από",
}
STARTING = {w for words in STARTING_BY_LANGUAGE.values() for w in words.split()}

# Kinds of what stands before a mark.
NOTHING, WORD, LONG, CAPITAL_END, LEAD, COUNTED, COUNTED_LETTER, ORDINAL, NUMBER, LISTED, INITIAL, PART, TRAIL, TIME, MID, NAME, SIGN = range(17)
# Marks.
POINT, STRONG, DOTS = range(3)
# What closes behind the mark: nothing, one or more quotes, brackets.
OPEN, QUOTE, QUOTES, BRACKET, BRACKETS = range(5)
# Gaps.
ATTACHED, SPACED = range(2)
# Kinds of what follows; the first of a word's kinds that holds.
END_OF_LINE, PAUSE, HYPHEN, DIGIT, OTHER, NO_CASE, FILE, MONTH, LONE, STARTER, JOINER, HELPER, LINKER, SAYER, PASSED, ANY = range(16)
# Shapes of a following word.
LOWER, UPPER, SHOUTED = range(3)

# What a mark says to the transducer.
NO, BREAK, END, ENDS_CLOSED, MAY_CLOSED, ENDS_CLOSED_2, MAY_CLOSED_2, OPEN_FIRST, OPEN_LATER, CLOSE = range(10)

_WORDS = {LONE, STARTER, JOINER, HELPER, LINKER, SAYER, PASSED, ANY, MONTH, FILE}


def next_kind(word: str) -> int:
    """The kind of a following word by the lists; a word is looked up lower-cased."""
    if word in MONTHS:
        return MONTH
    if word in SAYING:
        return SAYER
    if word in JOINING:
        return JOINER
    if word in HELPING:
        return HELPER
    if word in LINKING:
        return LINKER
    if word in STARTING or word in LEADING and len(word) > 1:
        return STARTER
    if word in PAST or word.endswith("ed") and len(word) > 4:
        return PASSED
    return ANY


def _rule(before: int, mark: int, closed: int, gap: int, nxt: int, shape: int, cased: bool) -> int:
    """What a mark says, by the kinds around it."""
    lower = shape == LOWER and nxt in _WORDS
    if gap == ATTACHED and closed == OPEN:  # no space follows, a letter or digit does
        if nxt in (FILE, DIGIT) or before in (NOTHING, SIGN):
            return NO
        if mark == POINT and before in (LEAD, COUNTED, COUNTED_LETTER, INITIAL, PART, TIME):
            return NO
        if nxt == NO_CASE:
            return END
        if cased:
            return END if shape == UPPER and before != CAPITAL_END else NO
        return END if nxt in (STARTER, LONE) or nxt == LINKER and before == LONG else NO
    goes_on = nxt == PAUSE or nxt == HYPHEN and closed != OPEN
    if closed == OPEN and mark == POINT:
        if before in (LEAD, LISTED):
            return NO
        if before == PART:  # of an abbreviation with points that no list has: what begins like a sentence is one
            return END if cased and nxt == STARTER and shape == UPPER else NO
        if before in (COUNTED, COUNTED_LETTER) and nxt == DIGIT or before == ORDINAL or before == NUMBER and nxt == MONTH:
            return NO
        if before in (INITIAL, COUNTED_LETTER) and nxt != END_OF_LINE:
            return NO
        if before in (TRAIL, TIME, MID, NAME):
            if goes_on:
                return NO
            if nxt == END_OF_LINE:
                return END
            if cased:
                return NO if lower or before == NAME and nxt == ANY else END
            if before in (MID, NAME):
                return END if nxt == STARTER else NO
            if nxt in (JOINER, HELPER, SAYER, PASSED) or before == TIME and nxt == LINKER:
                return NO
            return END
        if nxt == END_OF_LINE:
            return END
        return NO if goes_on or cased and lower else END
    if goes_on:
        return NO
    if closed in (BRACKET, BRACKETS):  # a remark in brackets only ends with them what it began
        return MAY_CLOSED if closed == BRACKET else MAY_CLOSED_2
    if nxt == END_OF_LINE:
        return {OPEN: END, QUOTE: ENDS_CLOSED}.get(closed, ENDS_CLOSED_2)
    if closed != OPEN:
        if cased:
            return NO if lower else ENDS_CLOSED if closed == QUOTE else ENDS_CLOSED_2
        if nxt in (SAYER, JOINER, HELPER, LINKER, PASSED):
            return NO
        return MAY_CLOSED if closed == QUOTE else MAY_CLOSED_2
    if cased:
        return NO if lower else END
    if mark == DOTS:
        return NO if before == NOTHING or nxt == JOINER else END
    return NO if nxt == PASSED and mark == STRONG else END


_SIZES = (17, 3, 5, 2, 16, 3, 2)
#: The compiled rules: one byte for each combination of kinds.
TABLE = bytes(_rule(*kinds[:6], bool(kinds[6])) for kinds in product(*map(range, _SIZES)))


def look_up(before: int, mark: int, closed: int, gap: int, nxt: int, shape: int, cased: bool) -> int:
    return TABLE[(((((before * 3 + mark) * 5 + closed) * 2 + gap) * 16 + nxt) * 3 + shape) * 2 + cased]


#: Nested quotations and brackets that are told apart; deeper ones count as this depth.
DEPTH = 15


def quotation_tables() -> tuple[list[list[int]], list[list[bool]]]:
    """(step, emit) of the transducer over what marks say.

    States: 0 at a sentence's start, 1 within it, then for each depth of open quotations or
    brackets one for a stretch opened at the start and one for a stretch opened later.
    """

    def state(depth: int, first: bool) -> int:
        return 2 * depth + (not first) if depth else 1

    steps, emits = [], []
    for s in range(2 * DEPTH + 2):
        depth, first = s // 2, s % 2 == 0
        step, emit = [], []
        for x in range(10):
            to, e = s, False
            if x == BREAK:
                to, e = 0, True
            elif x == END:
                to, e = (s, False) if depth else (0, True)
            elif x in (ENDS_CLOSED, MAY_CLOSED, ENDS_CLOSED_2, MAY_CLOSED_2):
                left = max(depth - (2 if x in (ENDS_CLOSED_2, MAY_CLOSED_2) else 1), 0)
                e = not left and (x in (ENDS_CLOSED, ENDS_CLOSED_2) or first)
                to = 0 if e else state(left, first)
            elif x in (OPEN_FIRST, OPEN_LATER):
                to = state(min(depth + 1, DEPTH), first if depth else s == 0 and x == OPEN_FIRST)
            elif x == CLOSE:
                to = state(max(depth - 1, 0), first)
            step.append(to)
            emit.append(e)
        steps.append(step)
        emits.append(emit)
    return steps, emits
