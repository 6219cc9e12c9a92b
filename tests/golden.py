"""Inputs and what each operator must make of them, for rules that the tables of documents never reach.

Fixed values: codes, stems and parts of single words and names.
"""

from __future__ import annotations

#: Texts, and their tokens as words, or as "kind:text" for those of other kinds.
TEXTS = {
    "": [],
    " \t\x01\n": [],
    "river 7 stones #lake @heron ⛵ @owl⛵": ["river", "number:7", "stones", "hashtag:#lake", "mention:@heron", "emoji:⛵", "mention:@owl", "emoji:⛵"],
    "We'll row, I'm sure; she'd swim.": ["We", "'ll", "row", "punct:,", "I", "'m", "sure", "punct:;", "she", "'d", "swim", "punct:."],
    "You shouldn't, he isn’t.": ["You", "shouldn't", "punct:,", "he", "isn’t", "punct:."],
    "'twas late, ’tis early": ["'twas", "late", "punct:,", "’tis", "early"],
    "l'orage, d’un coup, qu'elle, s'habiller": ["l'", "orage", "punct:,", "d’", "un", "coup", "punct:,", "qu'", "elle", "punct:,", "s'", "habiller"],
    "aujourd'hui Aujourd’hui": ["aujourd'hui", "Aujourd’hui"],
    "O'Neil, N'Golo, M'Bala, d'Artagnan": ["O'Neil", "punct:,", "N'Golo", "punct:,", "M'Bala", "punct:,", "d'", "Artagnan"],
    "the 80's, x's": ["the", "number:80", "'s", "punct:,", "x", "'s"],
    "t'#tag c'@me l'#amour_x": ["t'", "hashtag:#tag", "c'", "mention:@me", "l'", "punct:#", "amour_x"],
    "3.5 -12 1,000 4.5.6 7th 11º ₂": ["number:3.5", "number:-12", "number:1,000", "number:4.5", "punct:.", "number:6", "7th", "11º", "₂"],
    "2021-05-06 a_b c·d e--f -g h-": ["2021-05-06", "a_b", "c·d", "e--f", "punct:-", "g", "h", "punct:-"],
    "parle-t-il, donne-moi, vas-y": ["parle", "t", "il", "punct:,", "donne", "moi", "punct:,", "vas", "y"],
    "Dr. Ray, St. Ives, etc. p. 9 app. 2": ["Dr.", "Ray", "punct:,", "St.", "Ives", "punct:,", "etc.", "p.", "number:9", "app", "punct:.", "number:2"],
    "U.N. and É.U sign.Now": ["U.N.", "and", "É.U", "sign", "punct:.", "Now"],
    "http://a.example/x_(y)?q=1. https://b.example, (HTTP://c.example)": ["url:http://a.example/x_(y)?q=1.", "url:https://b.example", "punct:,", "punct:(", "url:HTTP://c.example)"],
    "ann@post.example.org bob.c@post.org d@x.org": ["email:ann@post.example.org", "bob", "punct:.", "email:c@post.org", "d", "punct:@", "x", "punct:.", "org"],
    "👩‍🚀 👍🏾 🇸🇪🇳🇴 ⛵️": ["emoji:👩‍🚀", "emoji:👍🏾", "emoji:🇸🇪🇳🇴", "emoji:⛵️"],
    "#a #ab $cd $5 #9lives #x_y @a @_b": ["punct:#", "a", "hashtag:#ab", "hashtag:$cd", "punct:$", "number:5", "punct:#", "9lives", "punct:#", "x_y", "punct:@", "a", "punct:@", "punct:_", "b"],
    "(\"so\") [then]… «là»": ["punct:(", "punct:\"", "so", "punct:\"", "punct:)", "punct:[", "then", "punct:]", "punct:…", "punct:«", "là", "punct:»"],
    "tab\there\x02now no space": ["tab", "here", "now", "no", "space"],
    "東京へ行く": ["東京へ行く"],
}
_OTHER = ("number", "hashtag", "mention", "emoji", "punct", "url", "email")
TOKENS = [(text, [tuple(t.split(":", 1)) if t.split(":")[0] in _OTHER else ("word", t) for t in listed]) for text, listed in TEXTS.items()]


def token_rows() -> list[tuple[int, str, list[tuple[str, str]]]]:
    """(number, text, tokens) of each case."""
    return [(i, text, tokens) for i, (text, tokens) in enumerate(TOKENS)]


SENTENCES = {
    "": [],
    " \n\x01 ": [],
    "It rains. Let us wait!": ["It rains.", "Let us wait!"],
    "Dr. Vane is late. Mme. Oke too": ["Dr. Vane is late.", "Mme. Oke too"],
    "One\n two.\nThree\nfour?": ["One\n two.", "Three\nfour?"],
    "So it goes... Then what? Nothing!!!": ["So it goes...", "Then what?", "Nothing!!!"],
    "The U.N. met. It ended": ["The U.N. met.", "It ended"],
    "She said \"no. Never. Go.\" He left.": ["She said \"no. Never. Go.\"", "He left."],
    "It was “dark. Cold.” We ran.": ["It was “dark. Cold.”", "We ran."],
    "An open \"quote. It never ends. No": ["An open \"quote. It never ends. No"],
    "See (above. Below). Then go.": ["See (above. Below).", "Then go."],
    "1. Mix it. 2. Bake it.": ["1. Mix it.", "2. Bake it."],
    "B) Stir. C) Serve.": ["B) Stir.", "C) Serve."],
    "Wait . . . what? Yes": ["Wait . . .", "what?", "Yes"],
    "Ends with etc. and goes on": ["Ends with etc. and goes on"],
    "Où ça ? Là ! Été… Ici": ["Où ça ?", "Là !", "Été…", "Ici"],
    "! odd": ["!", "odd"],
    "Version 2.5 is out.Now": ["Version 2.5 is out.Now"],
    "Plan B. It works. Q": ["Plan B. It works.", "Q"],
}

PARAGRAPHS = {
    "One.\n\nTwo.\r\n\r\nThree.\n\t\nFour.\r\rFive.\n\r \n\rSix.\nSeven": (["One.", "Two.", "Three.", "Four.", "Five.", "Six.\nSeven"], ["One.", "Two.", "Three.", "Four.", "Five.", "Six.", "Seven"]),
    "Head\nbody\n\n  tail": (["Head\nbody", "  tail"], ["Head", "body", "tail"]),
    "": ([""], [""]),
    "\n\nlast\n": (["", "last\n"], ["", "last", ""]),
}

HASHTAGS = {
    "#test": "test",
    "#Test": "Test",
    "#t": "t",
    "#T": "T",
    "#TestWhatever": "Test Whatever",
    "#testWhatever": "test Whatever",
    "#ÉpopéeRusse": "Épopée Russe",
    "#TestOkFinalT": "Test Ok Final T",
    "#Test123Whatever": "Test 123 Whatever",
    "#TDF2018": "TDF 2018",
    "#T2018": "T 2018",
    "#TheID2018": "The ID 2018",
    "#8YearsOfOneDirection": "8 Years Of One Direction",
    "#WordpressIDInformation": "Wordpress ID Information",
    "#LearnWCFInSixEasyMonths": "Learn WCF In Six Easy Months",
    "#This123thingOverload": "This 123 thing Overload",
    "#final19": "final 19",
    "$cashTag": "cash Tag",
    "#2018Paris": "2 018 Paris",
    "#8years": "8years",
    "#ABÉa": "AB Éa",
}
#: These are no hashtags.
NO_HASHTAGS = ("", "#", "test", "@Test")

FINGERPRINTS = {
    "University of North Carolina": "carolina north of university",
    " North Carolina, university of           ": "carolina north of university",
    "\x00UNIVERSITY OF NORTH CAROLINA": "carolina north of university",
    "University   of of north CarolINA\t": "carolina north of university",
    "University --- of --- North Carolina": "carolina north of university",
    "Café": "caf",
    "": "",
}

OMISSION = {
    "": "", "hello": "HLEO", "The quick brown fox jumped over the lazy dog.": "JKQXZVWYBFMGPDHCLNTREUIOA", "Christopher": "PHCTSRIOE",
    "Niall": "LNIA", "Иванов": "VNIAO", "Жуков": "KZVHUO", "caramel": "MCLRAE", "Carlson": "CLNSRAO", "Karlsson": "KLNSRAO", "Circumstantial": "MCLNTSRIUA",
    "LUMINESCENT": "MCLNTSUIE", "multinucleate": "MCLNTUIEA", "cœlomic": "MCLOEI", "Molecule": "MCLOEU", "Lacrimal": "MCLRAI",
}

UNIDECODE = {
    "": "", "plain": "plain", "Café Łódź": "Cafe Lodz", "Иванов": "Ivanov", "Щукин": "Shchukin", "Жуков": "Zhukov", "Юлия": "Iuliia",
    "Ёлкин": "Iolkin", "Чайковский": "Chaikovskii", "Αθήνα": "Athena", "Ψυχή": "Psukhe", "Ξένος": "Xenos", "½ §3 ©": "1/2 SS3 (c)", "中a": "a",
    "서울": "seoul", "한국어 x": "hangugeo x", "かな": "kana", "とうきょう": "toukyou", "にっぽん": "nippon", "まっちゃ": "matcha", "ラーメン": "ramen", "ファミリー": "famiri",
    "ウィキ": "wiki", "パーティー": "pati", "ヴァイオリン": "vaiorin", "デュオ": "dyuo", "ジェット": "jetto", "طهران": "thran", "שלום": "shlvm", "Երևան": "Erewan", "თბილისი": "tbilisi",
    "٢٠٢٤": "2024", "ｶﾅ": "kana", "あっ": "a",
}

SOUNDEX = {
    "": "", "Rupert": "R163", "Robert": "R163", "Rubin": "R150", "Ashcroft": "A261", "Tymczak": "T522", "Pfister": "P236",
    "Andrew": "A536", "Wozniak": "W252", "Callister": "C423", "Hello": "H400", "Martin": "M635", "Bernard": "B656", "Perez": "P620", "Иванов": "I151", "Жуков": "Z210", "Πέτρος": "P362",
    "Gros": "G620", "Gauthier": "G360", "Rey": "R000", "Barthélémy": "B634", "Henry": "H560", "Rousseau": "R200", "Pffister": "P123",
}

REFINED = {
    "": "", "testing": "T036084", "TESTING": "T036084", "The": "T0", "quick": "Q03", "brown": "B908", "fox": "F05", "jumped": "J08106",
    "over": "O209", "lazy": "L050", "dogs": "D043",
}
#: Names of one code each.
HOMOPHONES = (("Braz", "Broz"), ("Caren", "Charon", "Corain", "Corwin", "Curwen"), ("Hairs", "Hark", "Hayers"), ("Lambard", "Lampaert", "Limbert", "Lombard"), ("Nolton", "Noulton"))

PHONOGRAM = {
    "": "", "O": "o", "Comte": "knt", "Compte": "knt", "Thibault": "tb", "Martinot": "mrtn", "Gold": "kld", "Ghosn": "kn",
    "Ghassan": "sn", "Ghana": "kn", "Catherine": "ktrn", "Caitlyn": "ktrn", "Leblanc": "lbl", "Knopfler": "nflr", "Knight": "nt",
    "Dupond": "dp", "Dupont": "dp", "Estiennes": "tn", "Dimitrij": "dmtr", "Sachs": "sx", "Clarisse": "klrs", "Wicks": "vx",
    "Walther": "vltr", "Vaughan": "vn", "Jacquin": "ʒkn", "Poumellech": "pmlk", "Poumellec": "pmlk", "Djarachvilliy": "ʒrʃvl",
    "Dzarachvili": "ʒrʃvl", "Harari": "rr", "Hanoucca": "nk", "Sasha": "sʃ", "Chloé": "kl", "Chrystel": "krsl", "Adèle": "dl",
    "Maïré": "mr", "ZARIDJE": "srʒ", "AKOPASHVILI": "kpʃvl", "Brown": "brn", "Braun": "brn", "Slowcombe": "slkmb", "Popow": "ppf",
    "Wyrm": "vrm", "Lyutsifer": "lsfr", "Suciu": "ss", "Emyhr": "mr", "Throme": "trm", "Campbell": "kmbl", "Marouanne": "mrvn",
    "Merwanne": "mrvn", "Giacomo": "ʒkm", "Christopher": "krstfr", "Henrichsen": "nrxn", "Henricson": "nrxn", "Whitlam": "vtrm",
    "White": "vt", "Lewinsky": "lvnsk", "Szlamawicz": "ʃlmvʃ", "Roger": "rk", "Cosmes": "cm", "Meusnier": "mn", "Haussman,": "smn",
    "Haußmann": "smn", "Neufchâtel": "nʃtl", "Neufchastel": "nʃtl", "Rimbaud": "rmb", "Rheimbeau": "rmb", "Bouznah": "bʒn",
    "Xavier": "xv", "Javier": "xv", "Franziska": "frnssk", "Plushchenko": "plʃnk", "Chtcherbakov": "ʃrbkf", "Brezhnev": "brʒnf",
    "Lefébvre": "lfvr", "Le Fèvre": "lfvr", "Dijkstra": "dxtr", "Eugene": "kn", "Yevgeniy": "kn", "Madailéin": "mdln",
    "Thompson": "tmsn", "Champsfleuri": "ʃmflr", "Rasheed": "rʃd", "Patxaran": "pʃrn", "Brieuc": "br", "Shlamovitz": "ʃlmvʃ",
    "Khan": "kn", "Bigsby": "bxb", "Yaqob": "ʒkb", "Ashleigh": "ʃl", "Leigh": "l", "Dahlia": "dl", "Leah": "lea", "Ada": "ada", "Иванов": "vnf", "Попов": "ppf",
}

S_STEMS = {
    "": "", "one": "one", "is": "is", "reciprocity": "reciprocity", "queries": "query", "phrases": "phrase", "corpus": "corpus",
    "stress": "stress", "kings": "king", "aerodynamics": "aerodynamic", "congress": "congress", "serious": "serious", "ties": "ty",
    "ies": "ies", "shoes": "shoes", "és": "é",
}

PORTER_STEMS = {
    "caresses": "caress", "cats": "cat", "feed": "feed", "proceed": "proce", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "hopping": "hop", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "rational": "ration", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "falling": "fall",
    "controll": "control", "relate": "relat", "pirate": "pirat", "necessitate": "necessit", "you": "you", "catastrophe": "catastroph",
    "anathema": "anathema", "mathematics": "mathemat", "adjective": "adject", "mushroom": "mushroom", "building": "build",
    "spiteful": "spite", "external": "extern", "exterior": "exterior", "coffee": "coffe", "": "", "a": "a", "ying": "y", "€": "€",
}

CARRY_STEMS = {
    "Chiennes": "chien", "Tissaient": "tis", "Tisser": "tis", "Tisserand": "tisserand", "enflammer": "enflam", "groseilles": "groseil",
    "tentateur": "tenta", "tentateurs": "tenta", "tentatrice": "tenta", "tenter": "ten", "tenteras": "ten", "formateur": "forma",
    "formatrice": "forma", "former": "form", "formes": "form", "mangeassiez": "mang",
}

JUNK = {
    "aeaeaea": True, "aeaeae": False, "cbcbcbcb": True, "chevalier": False, "azazazazazazazazazazazazazazazazazazaz": True, "d": True,
    "d'": False, "créé": False, "créée": False, "creee": False, "creeee": True, "TATA": False, "committee": True, "": True,
}

LENGTHENING = {"cool": "cool", "coool": "coool", "cooooool": "coool", "cooooooooooolool": "cooolool", "100000000": "100000000"}
SQUEEZED = {"": "", "coucou": "coucou", "wwwwhatever": "whatever", "whateverrrrr": "whatever", "whattttttever": "whatever", "100": "10"}
MEASURES = {"tree": 0, "trouble": 1, "troubles": 2, "génériquement": 5, "rationalité": 4, "Tissaient": 2}
