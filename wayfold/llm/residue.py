"""Template residue, filler and page messages in place of real text.

A text is judged sentence by sentence (mark-up tags and line ends part sentences too):

* slot: an unfilled or wrongly filled template slot. Each kind of delimiter has its grammar; delimiters that
  ordinary text also uses (brackets, braces, percent signs ...) need an identifier or a phrase of a slot in them.
* filler: dummy Latin and layout words in a run, keys hit at random (by pairs of letters
  that no word has), or a sentence that only announces text to come,
  by a grammar of stand-in words, kinds of text and places.
* message: a status line, a page or server and what failed about it, what to do then, a requirement of
  scripts, or the trace of a program; each must make up a sentence from its start.

What merely speaks of such things is discounted: fenced and inline code is cut out, slots within quotation
marks don't count, nor do those in a sentence on templates and forms, or behind one that leads up to an example
with a colon, unless slots are dense there. All of it runs as expressions within Spark, on whole texts of any length; the grammars are
tried only on texts that hold one of their signs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: words of the grammars, in English, German, French and Spanish ---
_SLOT_NOUNS = (
    "name|names|surname|nickname|username|customer|user|client|buyer|seller|reviewer|product|brand|item|title|store|shop|city|country|town|"
    "location|date|month|year|day|time|order|variant|pros|cons|opinion|review|rating|text|message|experience|price|amount|colou?r|size|model|"
    "company|email|address|phone|number|link|url|category|feature|reason|signature|"
    "vorname|nachname|kunde|kundin|kundenname|produkt|produktname|marke|ort|stadt|datum|bestellung|bestellnr|bestellnummer|vorteile|nachteile|"
    "bewertung|erfahrung|preis|farbe|gr[oö](?:ss|ß)e|firma|artikel|anrede|"
    "nom|pr[eé]nom|produit|marque|ville|pays|commande|avantages|inconv[eé]nients|avis|exp[eé]rience|prix|magasin|couleur|taille|"
    "nombre|apellidos?|cliente|producto|marca|ciudad|fecha|pedido|ventajas|desventajas|opini[oó]n|rese[nñ]a|experiencia|precio|tienda|talla|art[ií]culo"
)
_INSTRUCTIONS = (
    "insert|add|describe|enter|type|fill in|your|here|hier|ihr|ihre|ihren|dein|deine|einsetzen|einf[uü]gen|eingeben|erg[aä]nzen|beschreiben|"
    "ins[eé]rer|ins[eé]rez|ajouter|ajoutez|d[eé]crire|d[eé]crivez|saisir|votre|vos|ici|insertar|inserte|a[nñ]adir|a[nñ]ada|agregar|describir|describa|su|tu|aqu[ií]"
)
_SMALL_WORDS = "le|la|les|el|los|las|das|den|die|der|the|a|an|de|del|du|des|of|for|first|last|full"
_DUMMY_LATIN = (
    "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|"
    "enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|"
    "reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|"
    "culpa|qui|officia|deserunt|mollit|anim|id|est|laborum|"
    "unde|iste|error|totam|rem|eaque|ipsa|quae|ab|illo|inventore|quasi|vitae|dicta|nemo|quia|aut|odit|fugit|magni|eos|ratione|sequi|neque|porro"
)
#: Endings of Latin words that words of five letters and more of the four languages seldom have in a row.
_LATIN_ENDINGS = "[ui]s|[uae]m|[ia]t|ur|ae|unt|ndi|tas|que"
_LAYOUT_WORDS = "title|subtitle|heading|headline|paragraph|body|caption|copy|dummy|word|text|image|button|label"
_KEY_ROWS = "abc|bla|blah|asd|asdf|sdfg|dfgh|fghj|ghjk|hjkl|jkl|qwe|qwer|qwert|qwertz|qwerty|azerty|yxcv|zxcv|xcvb|uiop|foo|lala"
_REASONS = (
    "bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file )?not found|method not allowed|not acceptable|proxy authentication required|"
    "request time-?out|conflict|gone|precondition failed|(?:payload|request entity|uri) too (?:large|long)|unsupported media type|too many requests|"
    "(?:internal )?server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|proxy error|access denied|"
    "seite nicht gefunden|nicht gefunden|interner (?:server)?fehler|zugriff verweigert|dienst nicht verf[uü]gbar|verboten|"
    "page (?:introuvable|non trouv[eé]e)|non trouv[eé]|acc[eè]s (?:refus[eé]|interdit)|erreur interne(?: du serveur)?|interdit|service indisponible|"
    "p[aá]gina no encontrada|no encontrad[oa]|acceso (?:denegado|prohibido)|error interno(?: del servidor)?|prohibido|servicio no disponible"
)

#: Pairs of letters that words of the four languages have only where two words are joined, if at all.
_ALIEN_PAIRS = (
    r"q[^uaeioq\W]|j[bcdfghklmpqrstvwxz]|[bcfghkmpqtvwxz]j|k[dfghjqvx]|[dfghjqvxz]k|f[bdghjkmqvwxz]|h[bcdfgjkpqvxz]|[dgjqvw]f|"
    r"g[fjkqvx]|[jvx]g|w[dfgjkpqvx]|[xqj]h|lj|lq|dq|sq[^uq]"
)

# --- slots: a grammar for each delimiter ---
_ID = r"[\p{L}_$][\p{L}\p{N}_.\-]*"
# an identifier by its shape: parts joined by _ or ., a capital inside, or capitals throughout
_SHAPED = r"(?-i:\p{L}[\p{L}\p{N}]*(?:[_.]\p{L}[\p{L}\p{N}]*)+|\p{Ll}+\p{Lu}\p{Ll}[\p{L}\p{N}]*|\p{Lu}[\p{Lu}\p{N}_]{2,})"
_NAMED = rf"(?:{_SHAPED}|{_SLOT_NOUNS})"
_PHRASE = rf"(?:(?:{_INSTRUCTIONS}|{_SLOT_NOUNS}|{_SMALL_WORDS})\s+|[ld]['’])*+(?:{_SHAPED.replace('{2,}', '{2,}_[\\p{Lu}_]+')}|{_SLOT_NOUNS}|{_INSTRUCTIONS})"
_TOLD = rf"(?:(?:{_INSTRUCTIONS}|product|produkt)\s[\p{{L}}\s']+|\p{{L}}+\s(?:{_INSTRUCTIONS}|name)|produktname|{_SHAPED.replace('{2,}', '*_[\\p{Lu}_]+')})"
_NOT_IN_WORD, _NO_WORD = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"

SLOT_GRAMMARS = {
    "double braces, perhaps with a filter or cut off": r"\{\{[\s>#/&!^{~]*[\p{L}_$]",
    "statement tags": r"\{%[^%\n]*%\}",
    "dollar, hash or at braces": r"[$#@]\{[^}\n]+\}",
    "single braces around a name or number": rf"(?iu)(?<![{{$#@\p{{L}}\p{{N}}])\{{\s?[$!]?(?:\p{{N}}{{1,2}}|{_ID})[!\\]?\s?\}}(?!\}})",
    "output tags": r"<%[^%\n]*%>|<\?[^?\n]*\?>",
    "model fields": rf"{_NOT_IN_WORD}@[Mm]odel\.\p{{L}}",
    "bars": rf"{_NOT_IN_WORD}\*\|[^|\n]+\|\*|(?<![\p{{L}}\p{{N}}|])\|\p{{Lu}}[\p{{Lu}}_]{{2,}}\|(?![\p{{L}}\p{{N}}|])",
    "bracket percent": r"\[%[^%\n]*%\]",
    "double brackets": r"\[\[[^\]\n]+\]\]",
    "percent signs": rf"%%?\p{{L}}[\p{{L}}_]{{2,}}%%?{_NO_WORD}",
    "format specifiers": rf"%\(\p{{L}}[\p{{L}}\p{{N}}_]*\)[sd]|%\p{{N}}\$[sd]|{_NOT_IN_WORD}%[sd]{_NO_WORD}",
    "at signs": rf"@@\p{{L}}[\p{{L}}\p{{N}}_.]*@@|{_NOT_IN_WORD}@\p{{L}}[\p{{L}}\p{{N}}_.]*@{_NO_WORD}",
    "hash signs": rf"##\p{{L}}[\p{{L}}\p{{N}}_.]*##|{_NOT_IN_WORD}#\p{{Lu}}[\p{{Lu}}\p{{N}}_]{{2,}}#{_NO_WORD}",
    "underscores": rf"(?iu)(?<![\p{{L}}\p{{N}}_])__(?:{_NAMED})__{_NO_WORD}",
    "shell names": rf"\$[\p{{Lu}}_]{{3,}}{_NO_WORD}|\$\p{{L}}+_[\p{{L}}_]+",
    "percent-encoded braces": r"(?i)%7b%7b",
    "brackets around a name": rf"(?iu)(?<![\p{{L}}\p{{N}}\[])\[\s?(?:{_PHRASE}|{_SHAPED})\s?\](?!\])",
    "angle brackets around a name": rf"(?iu)<\s?(?:{_PHRASE})\s?/?>",
    "parentheses around an instruction": rf"(?iu)\(\s?{_TOLD}\s?\)",
    "guillemets around a name": rf"(?iu){_NOT_IN_WORD}«(?:{_NAMED})»",
    "values of nothing": rf"\[object \p{{L}}+\]|{_NOT_IN_WORD}NaN{_NO_WORD}",
    "crossed out": rf"{_NOT_IN_WORD}X{{4,}}{_NO_WORD}",
    "blanks to fill in": r"(?<![\p{L}\p{N}_])_{4,}(?![\p{L}\p{N}_])",
}
#: A slot name in capitals and parentheses, in a sentence that is not in capitals itself.
_CAPITALS = rf"(?-iu:\((?:{_SLOT_NOUNS.upper()})\))"
_CAPITALS_SLOT = rf"^\W*{_CAPITALS}\W*$|\p{{Ll}}{{3}}.*{_CAPITALS}|{_CAPITALS}.*\p{{Ll}}{{3}}"
#: The word of a script language for an unset value, unless used as an ordinary adjective.
_UNDEFINED = rf"(?iu){_NOT_IN_WORD}(?:undefined|null\s+null){_NO_WORD}"
_UNDEFINED_ADJECTIVE = (
    r"(?iu)\b(?:is|are|was|were|be|been|being|stays?|stayed|remains?|remained|left|leaves?|an?|the|so|very|quite|still)\s+undefined"
    r"(?=\s*(?:[,.;:!?]|$|(?:and|but|or|in|by|for|because|until|shape|outline|term|edge)s?\b))"
)
#: What any slot must contain; spares most texts and sentences the grammars.
_SIGN = r"[{%$#@<\[«|]|__|\(\s?\p{L}|XXXX|NaN|(?i:undefined|null\s+null)"

#: Reports of forms, templates and courses: a slot in such a sentence is spoken of.
_SPOKEN_OF = (
    r"(?iu)\b(?:templates?|tutorials?|syntax|placeholders?|variables?|loops?|snippets?|explains?|explained|documentation|"
    r"asked (?:me )?for|form (?:asked|wanted|said)|vorlagen?|platzhalter|erkl[aä]rt|formular|mod[eè]les? de texte|"
    r"formulaire|explique|plantillas?|formulario|explica)\b"
)
#: Such a sentence, if it leads up to an example.
_LEADS_IN = _SPOKEN_OF + r"[^\n]*:\s*$"
_QUOTED = r"[\"“”„«»]\s?[{\[<%$#@_][^\"“”„«»\n]*[\"“”„«»]"
#: Words that a sentence must have for each slot to be a report of it.
WORDS_PER_SLOT = 4

# --- filler (matched against lower case) ---
def _one_of(words: str) -> str:
    """An expression for ``a|b|...`` that shares common beginnings, so that a word is read once."""
    tree: dict = {}
    for word in words.split("|"):
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def written(at: dict) -> str:
        ways = [c + written(rest) for c, rest in sorted(at.items()) if c]
        inner = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""
        return f"(?:{inner})?" if "" in at and inner else inner

    return written(tree)


_LATIN = rf"(?:{_one_of(_DUMMY_LATIN)}{_NO_WORD}|\p{{L}}{{5,}}+(?<=[smtredi])(?<={_LATIN_ENDINGS}))"
_CONSONANT = "[bcdfghjklmnpqrstvwxz]"
_ALIEN = rf"(?=[b-df-hj-lpqstv-xz][b-df-hj-mpqtv-xz])(?={_ALIEN_PAIRS})\p{{L}}"
#: Patterns, and a cheap one that every text must match for it.
FILLER_PATTERNS = {
    "dummy Latin": (None, rf"(?<!\p{{L}}){_LATIN}(?:[,.;:]?\s+{_LATIN}){{4}}"),
    "layout words": (None, rf"(?<!\p{{L}}){_one_of(_LAYOUT_WORDS)}(?:[,.;/|]?\s+{_one_of(_LAYOUT_WORDS)}{_NO_WORD}){{3}}"),
    "one unit again and again": (
        r"(?<!\p{L})(\p{L}{2})\p{L}*+[^\p{L}]{1,8}+\1\p{L}*+[^\p{L}]{1,8}+\1",
        rf"{_NOT_IN_WORD}(\p{{L}}{{2,6}}?)\1+(?:\s+\1+{_NO_WORD}){{3}}|{_NOT_IN_WORD}(\p{{L}}{{2,6}})(?:\s+\2){{0,3}}\s+\2{{2,}}(?:\s+\2+{_NO_WORD}){{2}}|"
        rf"{_NOT_IN_WORD}({_KEY_ROWS})(?:\s+\3+{_NO_WORD}){{3}}|{_NOT_IN_WORD}(\p{{L}}{{2,}})(?:\W+\4{_NO_WORD}){{11}}",
    ),
    "keys at random": (_CONSONANT + "{4}", rf"\b(?:(?:\p{{L}}*?{_ALIEN}){{3}}|(?=\p{{L}}{{5,9}}\b)(?:\p{{L}}*?{_ALIEN}){{2}})|\b{_CONSONANT}{{4,}}+(?:\s+{_CONSONANT}{{4,}}+{_NO_WORD}){{2}}"),
}
_N_EN, _N_DE = "(?:text|review|content|copy|comment|paragraph|body|description|headline|title|caption|feedback|line|sentence)", "(?:text|bewertung|inhalt|rezension|kommentar|beschreibung|absatz|titel)"
_N_FR, _N_ES = "(?:texte|avis|contenu|commentaire|paragraphe|description|titre)", "(?:texto|rese[nñ]a|opini[oó]n|contenido|comentario|p[aá]rrafo|descripci[oó]n|t[ií]tulo)"
_FAKE_EN = "(?:sample|dummy|filler|placeholder|example|test|mock|demo|default|temporary)"
_FAKE_DE = "(?:platzhalter|beispiel|blind|f[uü]ll|muster|test|dummy|demo)"
_FAKE_FR = "(?:remplissage|exemple|test|d[eé]monstration|substitution|factice|provisoire|fictif)"
_FAKE_ES = "(?:relleno|ejemplo|prueba|muestra|demostraci[oó]n|provisional|ficticio)"
_TAIL_EN = rf"(?: (?:only|here|goes|for|of|the|your|a|our|please|ignore|delete|replace|remove|do|not|use|publish|to|be|replaced|removed|this|product|{_N_EN}))*"
#: Sentences that only stand for text to come: a stand-in and a kind of text; a kind of text and a place or
#: time; an order to write one.
_ANNOUNCEMENTS = "|".join([
    rf"(?:this is |here is |just )?(?:an? |some |the )?{_FAKE_EN}(?: {_FAKE_EN}| {_N_EN})*[ -]{_N_EN}(?:\W{{1,3}}(?=please|ignore|do not|delete)|){_TAIL_EN}", rf"placeholder(?: (?:for|text|copy|here){_TAIL_EN})?",
    rf"(?:your |the |this |insert |customer |product )*(?:{_N_EN} ?)+(?:goes|comes|belongs|will (?:go|be|appear|follow)|to (?:follow|come)|to be (?:supplied|added|written|provided|determined|announced|filled in|confirmed|replaced)|coming|tbd|tba|here)(?: here| soon| later| shortly)?",
    rf"(?:please )?(?:insert|enter|type|write|add|put|paste|fill in|edit)(?: in)?(?: your| the| an?| this| some| own| product| customer)*(?: {_N_EN})+(?: here| below)", rf"(?:please )?replace (?:this|the|these) {_N_EN}s?(?: (?:with|by) (?:your|the|real|actual)\b[\w ]*)?",
    r"(?:please )?(?:write|use|enter) at least \w+ (?:characters|words|letters|sentences)", rf"(?:insert|enter|add|write|type|put) your {_N_EN}(?: \w+)?",
    rf"(?:das ist |dies ist )?(?:ein |nur |der )?(?:platzhalter|{_FAKE_DE}[- ]?{_N_DE})(?: (?:f[uü]r|bitte|ignorieren|l[oö]schen|ersetzen|hier|nicht|ver[oö]ffentlichen|der|die|das|den|eine?n?|ihre?n?|{_N_DE}))*",
    rf"(?:hier|an dieser stelle) (?:steht|kommt|folgt|erscheint|entsteht)(?: \w+)*? {_N_DE}(?: \w+){{0,2}}", r"hier (?:steht|kommt|folgt) (?:ihre?|der|die|das|dein)(?: [\p{L}]+){1,3}",
    rf"(?:ihre? |deine? |der |die |das |hier )?{_N_DE} (?:folgt|kommt|hier)(?: noch| in k[uü]rze| bald| sp[aä]ter| hier)*", rf"(?:bitte )?(?:ihre?n? |den |die )?{_N_DE} (?:bitte )?(?:hier )?(?:eingeben|einf[uü]gen|einsetzen|erg[aä]nzen|ersetzen|schreiben|ignorieren|l[oö]schen)",
    rf"(?:ceci est )?(?:un |le |du )?(?:{_N_FR}|exemple) (?:de |d['’])?(?:{_FAKE_FR}|{_N_FR}|[aà] (?:venir|compl[eé]ter|remplacer))(?:,? (?:pour|merci|de|d['’]|l['’]|la|le|votre|ne pas|[aà]|ignorer|ignorez|publier|remplacer|tenir compte)|[ ](?:[ld]['’])?{_N_FR})*(?:d['’]ignorer)?",
    rf"(?:votre|le|la|ins[eé]rer) {_N_FR} (?:ici|suit|va ici|vient ici|sera ici|bient[oô]t|appara[iî]tra ici)",
    rf"(?:veuillez )?(?:saisi(?:ssez|r)|ins[eé]re[rz]|[eé]cri(?:vez|re)|ajoute[rz]|entre[rz]|tapez|collez|remplace[rz])(?: ici)? (?:votre|vos|le|un|ce|cet)(?: {_N_FR})(?: ici| ci-dessous| par [\p{{L}}' ]+)?",
    rf"(?:est[eo] es )?(?:una? |el |la )?(?:{_N_ES}|ejemplo) (?:de |para )?(?:{_FAKE_ES}|{_N_ES}|pendiente)(?:,? (?:ignorar|ignore|por favor|no publicar|para|la|el|su|de|sustituir|{_N_ES}))*",
    rf"(?:su|tu|el|la) {_N_ES} (?:va |ir[aá] |aparecer[aá] |vendr[aá] )?(?:aqu[ií]|pronto|pr[oó]ximamente)",
    rf"(?:por favor,? )?(?:escrib[ae]|introdu(?:zca|ce)|insert[ae]|a[nñ]ad[ae]|pegue|agregue|sustituya|reemplace)(?: aqu[ií])? (?:su|tu|el|la|una?|este|esta) {_N_ES}(?: aqu[ií]| por [\p{{L}} ]+)?",
])
#: Alone in its sentence, or said twice.
_ANNOUNCED = rf"(?md)^\W*(?:(?:{_ANNOUNCEMENTS})\W*$|((?:{_ANNOUNCEMENTS})(?!\p{{L}}))\W+\1)"

# --- messages (matched against lower case, at the start of a sentence) ---
_S = r"(?:java ?script|(?:java)?scripts?|cookies|active content|java-?skripte?|skripte|les (?:cookies|scripts)|los scripts|las cookies)"
_PAGE = r"(?:(?:this|the|that|your|our|requested|upstream|remote|origin)\s)*(?:page|site|website|web ?page|resource|url|server|session|request|content|review|document|host)"
_ENDED = r"(?=\W*$|\s?[\-–—:|(]|[.,!?]\s)"
_TITLE_END = r"(?=\W*$)"
_PAGE_SENTENCES = "|".join([
    # English: a page or server and what failed; what to do then
    rf"{_PAGE}(?: you (?:asked for|requested|(?:are|were) looking for|tried to (?:open|reach|access)))?(?: has| was| is| took| can(?:'|’)?t| can ?not| could ?n(?:o|'|’)t| does ?n(?:o|'|’)t| did ?n(?:o|'|’)t| returned)(?: been| be| too| currently| temporarily| permanently| no longer| not)*"
    r" (?:found|reached|loaded|displayed|shown|opened|completed|processed|retrieved|expired|timed out|moved|removed|deleted|blocked|unavailable|available|accessible|exist|respond|answer|long|down|overloaded|an? (?:invalid|unexpected|empty) (?:response|reply))\b",
    r"(?:the )?(?:page|resource|document) you (?:asked for|requested|(?:are|were) looking for)\b", rf"(?:page|site|url|resource) (?:not found|unavailable|expired){_ENDED}",
    r"(?:your |the )?(?:request|connection|session|login) (?:has |was )?(?:timed out|expired|reset by peer|refused)" + _ENDED, r"an? (?:\w+ )?error (?:has )?(?:occurred|happened)\b", r"we (?:hit|ran into) (?:a|an) (?:snag|problem|error)" + _ENDED,
    r"we(?:'re| are| were|’re)? ?(?:sorry,? but |unable to |could ?n(?:o|'|’)t |can(?:'|’|no)?t )(?:find|load|process|complete|display|reach|show) (?:the|this|that|your) (?:page|request|site|content|resource|reviews?)\b",
    r"(?:too many|unusual) (?:requests|traffic) (?:from|for|in)\b", r"service (?:is )?(?:temporarily|currently) (?:unavailable|not available)", r"(?:the )?(?:site|website|page|service|server) is (?:down for|under|undergoing|in) (?:scheduled )?maintenance",
    r"if (?:the|this) (?:problem|error|issue) persists\b", r"(?:our|the) (?:team|administrators?|engineers|webmaster|developers) (?:has|have|was|were) (?:been )?(?:told|notified|informed|alerted)",
    r"(?:please )?try again (?:later|in a (?:few|moment|while)\b[\w ]*|shortly)\W*$", r"(?:please )?(?:check|verify) the (?:address|url|link)\b", r"(?:please )?(?:go|return|back|take me)(?: back)? to (?:the )?(?:home ?page|start page|main page|previous page|homepage)\b",
    r"(?:please )?(?:sign|log) in (?:again )?to (?:continue|proceed|view|see)\b", r"(?:please )?(?:refresh|reload) (?:the|this) page\W*$", r"(?:please )?contact (?:the|your) (?:site |system |web ?site )?administrator\b",
    # German
    r"(?:es |da |hier )?(?:ist )?(?:leider )?(?:etwas|ein (?:\p{L}+ )?fehler)(?: ist)?(?: leider)? (?:schief ?(?:gelaufen|gegangen)|aufgetreten)", r"(?:ihre|die) sitzung ist abgelaufen", r"(?:die |diese )?(?:angeforderte|gesuchte|aufgerufene|gew[uü]nschte) (?:seite|adresse|datei|ressource)\b",
    r"(?:die |diese |website |web)*seite (?:konnte|kann|wurde|existiert|ist)(?: leider| derzeit| zurzeit)? nicht (?:gefunden|geladen|angezeigt|mehr|erreichbar|verf[uü]gbar)", r"seite nicht (?:gefunden|verf[uü]gbar|erreichbar)", rf"zugriff (?:verweigert|nicht erlaubt){_ENDED}",
    r"(?:der |dieser )?(?:dienst|server|service)(?: ist)? (?:vor[uü]bergehend|derzeit|zurzeit|momentan) nicht (?:verf[uü]gbar|erreichbar)", r"interner (?:server)?fehler", r"zeit[uü]berschreitung\b", r"bitte (?:versuchen|probieren) sie es (?:sp[aä]ter|erneut|noch ?(?:ein)?mal|nochmals|in (?:k[uü]rze|einigen|wenigen)|zu einem)",
    r"zur[uü]ck zur (?:startseite|hauptseite)", r"bitte melden sie sich (?:erneut|neu|wieder|noch ?mal) an", r"(?:diese|die|unsere) (?:seite|website) wird (?:gerade |derzeit )?gewartet",
    # French
    r"(?:oups,? )?une erreur (?:\p{L}+ )?(?:est survenue|s['’]est produite)", r"(?:votre|la) session a expir", r"page (?:introuvable|non trouv[eé]e|inexistante)", r"(?:d[eé]sol[eé],? )?(?:la|cette) page (?:demand[eé]e|que vous (?:cherchez|recherchez|avez demand[eé]e)|est introuvable|n['’]existe (?:pas|plus))",
    rf"acc[eè]s (?:refus[eé]|interdit){_ENDED}", r"(?:le |ce )?(?:service|site|serveur)(?: est)? (?:temporairement|momentan[eé]ment|actuellement) (?:indisponible|inaccessible)", r"(?:veuillez|merci de) (?:r[eé]essayer|vous reconnecter|actualiser|recharger)", r"r[eé]essayez (?:plus tard|dans)",
    r"retour(?:ner|nez)? [aà] (?:l['’]accueil|la page d['’]accueil)", r"d[eé]lai (?:d['’]attente )?d[eé]pass[eé]", r"erreur interne\b",
    # Spanish
    r"(?:vaya,? |ups,? |lo sentimos,? )?algo (?:ha )?sali(?:[oó]|do) mal", r"(?:ha ocurrido|se ha producido|se produjo|ocurri[oó]) un error", r"(?:su|tu|la) sesi[oó]n ha (?:caducado|expirado)", r"p[aá]gina no (?:encontrada|disponible)", r"(?:la|esta) p[aá]gina (?:solicitada|que busca|no existe|no est[aá] disponible|ya no)",
    r"no se (?:ha )?(?:encontr|pud|pued)[\p{L}]* (?:encontrar |mostrar |cargar )?(?:la|esta) p[aá]gina", rf"acceso (?:denegado|prohibido){_ENDED}", r"(?:el )?(?:servicio|servidor|sitio)(?: est[aá])? (?:temporalmente |moment[aá]neamente )?no (?:est[aá] )?disponible",
    r"(?:por favor,? )?int[eé]nt(?:elo|alo) (?:de nuevo|otra vez|m[aá]s tarde)", r"vuelva a (?:iniciar sesi[oó]n|intentar)", r"volver (?:al inicio|a la p[aá]gina)", r"tiempo de espera agotado", r"error interno\b",
])
_SORRY = r"(?:o+ps|whoops|uh[- ]?oh|oh no|sorry|we(?:'|’| a)re sorry|hoppla|ups|oups|vaya|lo sentimos|d[eé]sol[eé]e?)"
_WENT_WRONG = r"(?:something (?:has )?(?:went|gone) wrong|access (?:is |was )?denied|permission denied|etwas ist schief ?gelaufen)"
MESSAGE_PATTERNS = {
    "status": rf"(?:(?:https?(?:/[\d.]+)?|error|fehler|erreur|status|code|err)\W{{0,3}})*[45]\p{{N}}{{2}}\s?[:\-–—|]?\s?(?:error\s?[:\-–—]?\s?)?(?:{_REASONS}){_ENDED}|(?:https?|error|fehler|erreur|status code|error code)\W{{0,3}}[45]\p{{N}}{{2}}{_ENDED}",
    "reason": rf"(?:{_REASONS}){_TITLE_END}|(?:internal server error|bad gateway|gateway time-?out|interner serverfehler){_ENDED}",
    "sentence of an error page": _PAGE_SENTENCES,
    "excuse": rf"{_SORRY}\W+(?:\p{{L}}+(?:['’]\p{{L}}+)?\s){{0,4}}?(?:{_WENT_WRONG}|{_PAGE_SENTENCES}|{_REASONS})|o+ps\W*$|{_WENT_WRONG}(?:{_TITLE_END}|\s?[\-–—:|]\s*(?:{_PAGE_SENTENCES}|(?:please )?try again))",
    "scripts required": "|".join([
        rf"(?:please |you (?:need|have) to |you must )?(?:re-?enable|enable|activate|allow|turn on|switch on|unblock) (?:the |your |browser(?:'s)? )*{_S}\b", rf"{_S} (?:is|are|must be|has to be|needs? to be|seems? to be|appears to be)(?: currently| not| also)? (?:required|needed|disabled|enabled|blocked|turned off|switched off|off|necessary|deactivated|supported|allowed)\b",
        rf"(?:this|our|the) (?:site|page|website|web ?app|application|shop|feature|widget) (?:needs|requires|uses|relies on|(?:does not|doesn't|will not|won't) work without|works only with) (?:to have )?{_S}\b",
        rf"(?:your|this) (?:web )?browser (?:(?:does not|doesn't|cannot|can't) (?:support|run|accept|display)|is not (?:supported|allowed)|is (?:too old|out of date|outdated|no longer supported|blocking|unsupported)|blocks|has (?:disabled|blocked|turned off|{_S}))",
        rf"(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:die |ihre |in ihrem browser )*{_S}", rf"{_S} (?:ist|sind|muss|m[uü]ssen|wird|werden)\b(?: \p{{L}}+){{0,5}}? (?:erforderlich|aktiviert|deaktiviert|n[oö]tig|ben[oö]tigt|blockiert|ausgeschaltet|abgeschaltet)",
        rf"(?:diese|unsere|die) (?:web)?(?:seite|site|anwendung) (?:ben[oö]tigt|braucht|erfordert|verlangt|nutzt|funktioniert nicht ohne) {_S}", rf"ihr (?:web)?browser (?:unterst[uü]tzt (?:kein|dies|diese|die|nicht|leider)|blockiert|akzeptiert kein|ist (?:veraltet|zu alt)|hat {_S}|wird nicht)",
        rf"(?:veuillez |merci d['’])?(?:activer|activez|autoriser|autorisez) {_S}", rf"{_S} (?:est|sont|doit|doivent|semble)\b(?: \p{{L}}+){{0,4}}? (?:requis|activ|d[eé]sactiv|n[eé]cessaire|bloqu|obligatoire)", rf"(?:cette page|ce site|cette application|notre site) (?:a besoin d[e'’]|n[eé]cessite|requiert|exige|utilise|ne fonctionne pas sans) ?{_S}",
        r"votre navigateur (?:ne (?:prend|supporte|permet|g[eè]re|peut)|bloque|n['’](?:accepte|autorise|est pas)|est (?:obsol[eè]te|trop ancien|p[eé]rim[eé])|a (?:d[eé]sactiv|bloqu))",
        rf"(?:por favor,? |debe |tiene que )?(?:active|activar|habilite|habilitar|permita|permitir) {_S}", rf"(?:se requiere|se necesita|hace falta) {_S}", rf"{_S} (?:es|est[aá]n?|debe|deben|parece)\b(?: \p{{L}}+){{0,4}}? (?:necesari|obligatori|desactivad|requerid|bloquead|habilitad|activad)|{_S} es (?:necesario|obligatorio)",
        rf"(?:esta p[aá]gina|este sitio|esta web|nuestra web) (?:necesita|requiere|usa|utiliza|no funciona sin) {_S}", rf"(?:su|tu|el) navegador (?:no (?:admite|soporta|permite|acepta|es compatible)|bloquea|tiene {_S}|est[aá] (?:desactualizado|obsoleto|bloqueando))",
    ]),
    "trace of a program": r"traceback \(most recent call|(?:fatal|parse|syntax) error:|(?:warning|notice): (?:undefined|trying|division|mysql|failed)|sqlstate\[|ora-\d{5}|upstream connect error|connection (?:refused|reset|timed out)" + _ENDED
    + r"|(?:[a-z_]+\.){2,}[a-z]*(?:exception|error)\b|(?:uncaught )?[a-z]{3,30}(?:error|exception)\s?[:(]\s|at [a-z_$.]+\([a-z_.]+:\d+\)|segmentation fault|core dumped",
}
_PAGE_MARKUP = (
    r"<(?:!doctype html|html\b[^>]*>\s*<(?:head|body)|noscript>)|^\s*\{\s*\"(?:status|code|error|errors|message)\"\s*:|"
    r"\berr_[a-z]+_[a-z_]+|\be(?:connrefused|connreset|timedout|notfound|acces)\b"
)

_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#123;": "{", "&#125;": "}", "&#91;": "[", "&#93;": "]", "&#37;": "%",
             "&#36;": "$", "&#60;": "<", "&#62;": ">", "&lbrace;": "{", "&rbrace;": "}", "&amp;": "&"}
_PARTS = r"([.!?…])\s++|[\r\n]++|\s/\s|</?(?:html|head|title|body|h\d|hr|p|br|b|i|em|strong|div|span|li|ul|noscript)\s?/?>"

_SLOT, _FILLER, _MESSAGE, _CONTEXT = 1, 2, 4, 8


def _any(patterns) -> str:
    # a flag at the start of an alternative holds to the end of its group
    return "|".join(f"(?:{p})" for p in patterns)


def without_code(text: Column) -> Column:
    """``text`` with closed code fences and inline code, of any length, replaced by a blank."""
    fences = F.split(text, "```")
    # every second part is within a fence; a last fence that isn't closed is none
    kept = F.filter(fences, lambda _, i: (i % 2 == 0) | ((i == F.size(fences) - 1) & (F.size(fences) % 2 == 0)))
    return F.when(F.contains(text, F.lit("`")), F.regexp_replace(F.array_join(kept, " "), "`[^`\n]*+`", " ")).otherwise(text)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    # within functions on arrays this keeps the compiled pattern, which rlike doesn't
    return F.regexp_instr(text, F.lit(pattern)) > 0


def _in_lines(text: Column) -> Column:
    """``text`` with a sentence on each line."""
    return F.regexp_replace(text, _PARTS, "$1\n")


# every grammar begins with one of these signs
_SLOTS = rf"(?=[{{$#@<%*|\[_(«XN])(?:{_any(SLOT_GRAMMARS.values())})"
_MESSAGES = rf"(?md)^\W{{0,3}}(?:{_any(MESSAGE_PATTERNS.values())})"
_LINES = rf"(?md)^\W{{0,3}}+(?:{_any(MESSAGE_PATTERNS.values())}|{_ANNOUNCEMENTS})|^\W{{4,}}(?:{_ANNOUNCEMENTS})"


def _slot_step(found: Column, s: Column) -> Column:
    """Bits after sentence ``s``: a slot so far, and whether ``s`` leads up to an example of a template."""

    def judged(bare: Column) -> Column:
        unset = _found(F.regexp_replace(s, _UNDEFINED_ADJECTIVE, " "), _UNDEFINED)
        count = F.regexp_count(bare, F.lit(_SLOTS))
        holds = (count > 0) | _found(bare, _CAPITALS_SLOT) | unset
        talk = _found(s, _SPOKEN_OF)
        # where slots are dense, a word about templates doesn't make it a report
        report = (talk | (found.bitwiseAND(_CONTEXT) != 0)) & (count * WORDS_PER_SLOT <= F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1)
        return found.bitwiseAND(_SLOT).bitwiseOR(F.when(holds & ~report, _SLOT).when(~holds & _found(s, _LEADS_IN), _CONTEXT).otherwise(0))

    plain = found.bitwiseAND(_SLOT).bitwiseOR(F.when(_found(s, _LEADS_IN), _CONTEXT).otherwise(0))
    return F.when(_found(s, _SIGN), _bound(F.regexp_replace(s, _QUOTED, " "), judged)).otherwise(plain)


def residue_kinds(text: Column) -> Column:
    """An array with 'slot', 'filler', 'message' as far as ``text`` holds them; empty for null or blank."""
    given = F.coalesce(text, F.lit(""))
    decoded = given
    for entity, sign in _ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(sign))
    whole = without_code(F.when(F.contains(given, F.lit("&")), decoded).otherwise(given))

    def in_a_row(t: Column) -> Column:
        hit = F.lit(False)
        for sign, pattern in FILLER_PATTERNS.values():
            hit = hit | (_found(t, pattern) if sign is None else _found(t, sign) & _found(t, pattern))
        return hit

    def judged(w: Column, low: Column) -> Column:
        # what no grammar fits in the whole is not taken apart
        might = _found(w, _SIGN) & (_found(w, _SLOTS) | _found(w, _CAPITALS) | _found(w, _UNDEFINED))
        has_slot = might & (F.aggregate(F.split(_in_lines(w), "\n"), F.lit(0), _slot_step).bitwiseAND(_SLOT) != 0)
        in_line = _bound(F.when(_found(low, r"[/\n]"), F.regexp_replace(low, r"\s*+[/\n]\s*+", " ")).otherwise(low), in_a_row)

        def kinds(lines: Column) -> Column:
            # one pass for both, and two more for the few texts that it finds
            either = _found(lines, _LINES)
            has_filler = in_line | (either & _found(lines, _ANNOUNCED))
            has_message = _found(low, _PAGE_MARKUP) | (either & _found(lines, _MESSAGES))
            return F.array_compact(F.array(F.when(has_slot, F.lit("slot")), F.when(has_filler, F.lit("filler")), F.when(has_message, F.lit("message"))))

        return _bound(_in_lines(low), kinds)

    return _bound(whole, lambda w: _bound(F.lower(w), lambda low: judged(w, low)))


def find_residue(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kinds)`` of the documents whose text holds residue; one row per input row, no shuffle.

    Null, empty and blank texts hold none. Repeated rows are judged alike. Only the two named columns are
    read, so any others may be there.
    """
    return (
        documents.select(F.col(f"`{id_col}`").alias(id_col), residue_kinds(F.col(f"`{text_col}`")).alias("kinds"))
        .where(F.size("kinds") > 0)
    )
