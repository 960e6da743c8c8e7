"""Names and characters that LaTeX or its conversion defines."""

from __future__ import annotations

# Environments whose body is taken as it is written.
RAW_ENVIRONMENTS = frozenset("verbatim verbatim* Verbatim BVerbatim lstlisting minted alltt comment filecontents filecontents*".split())

# Heading commands and their levels.
HEADINGS = {"part": 0, "chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
#: A level's command when tokens become text again; \part comes back as \chapter.
HEADING_NAMES = ("chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")

# Reference commands.
REFERENCES = frozenset("ref eqref autoref nameref pageref cref Cref vref".split())

# Citation commands and their modes.
CITATIONS = {
    "cite": "normal",
    "citep": "parenthetical",
    "citet": "textual",
    "citealt": "alt",
    "citealp": "alp",
    "citeauthor": "author",
    "citeyear": "year",
    "citeyearpar": "yearpar",
    "autocite": "normal",
    "textcite": "textual",
    "parencite": "parenthetical",
    "footcite": "normal",
}

# Commands that stand as blocks of their own at a block's start.
BLOCK_COMMANDS = frozenset(
    "documentclass par noindent hline hrule include input usepackage newcommand renewcommand providecommand def "
    "DeclareRobustCommand newenvironment renewenvironment newtheorem newtheorem* bibliography addbibresource "
    "bibliographystyle title author date graphicspath pagestyle thispagestyle maketitle tableofcontents".split()
)

# Environments by the way they are read.
QUOTES = frozenset("quote quotation displayquote verse".split())
MATH = frozenset(
    "equation equation* align align* gather gather* multline multline* flalign flalign* alignat alignat* "
    "eqnarray eqnarray* displaymath math split".split()
)
ALIGNED = frozenset("align alignat flalign eqnarray split multline".split())
TABLES = frozenset("table table* sidewaystable sidewaystable*".split())
TABULARS = frozenset("tabular tabular* tabularx longtable array tabu supertabular".split())
WIDE_TABULARS = frozenset("tabular* tabularx tabu".split())
FIGURES = frozenset("figure figure* sidewaysfigure wrapfigure".split())
DRAWINGS = frozenset("tikzpicture tikzcd pgfpicture".split())
#: Environments that only let their content through: braced arguments, and whether an option may come first.
THROUGH = {name: (0, False) for name in "center flushleft flushright sloppypar samepage titlepage singlespace landscape footnotesize small large".split()}
THROUGH |= {"minipage": (1, True), "multicols": (1, False), "spacing": (1, False)}

# Rules and row commands inside tables.
TABLE_RULES = frozenset(
    "hline toprule midrule bottomrule cline cmidrule cmidrules morecmidrules addlinespace specialrule rowcolor "
    "arrayrulecolor noalign endfirsthead endhead endfoot endlastfoot".split()
)

# Theorem-like environments that need no definition (name: shown as, numbered).
THEOREMS = {
    "theorem": ("Theorem", True),
    "lemma": ("Lemma", True),
    "proposition": ("Proposition", True),
    "corollary": ("Corollary", True),
    "definition": ("Definition", True),
    "example": ("Example", True),
    "proof": ("Proof", False),
}

# Macros that need no definition.
MACROS = {
    "LaTeX": "LaTeX",
    "TeX": "TeX",
    "LaTeXe": "LaTeX2e",
    "BibTeX": "BibTeX",
    "ie": "i.e.",
    "eg": "e.g.",
    "cf": "cf.",
    "etc": "etc.",
    "etal": "et al.",
    "vs": "vs.",
}

# Bibliography styles.
NUMERIC_STYLES = frozenset("plain abbrv unsrt alpha ieeetr acm siam unsrtnat".split())
AUTHOR_YEAR_STYLES = frozenset(
    "plainnat abbrvnat apalike apa chicago agsm harvard authordate1 authordate2 authordate3 authordate4 kluwer newapa named".split()
)

# Layout commands without output, by braced arguments and whether an option may come first.
LAYOUT = {
    name: (0, False)
    for name in (
        "centering raggedright raggedleft noindent indent newpage clearpage cleardoublepage samepage protect relax "
        "ignorespaces strut hfill vfill hss break nobreak allowbreak frenchspacing nonfrenchspacing sloppy fussy "
        "selectfont normalfont em bfseries mdseries itshape upshape slshape scshape rmfamily sffamily ttfamily bf it "
        "tt sc sl rm sf cal tiny scriptsize footnotesize small normalsize large Large LARGE huge Huge appendix "
        "frontmatter mainmatter backmatter tableofcontents listoffigures listoftables printindex makeatletter "
        "makeatother onecolumn flushbottom raggedbottom qedhere smallbreak medbreak bigbreak smallskip medskip "
        "bigskip leavevmode unskip doublespacing singlespacing onehalfspacing endinput hrulefill dotfill checkmark "
        "newblock boldmath unboldmath ignorespacesafterend"
    ).split()
}
LAYOUT |= {name: (0, True) for name in "pagebreak nopagebreak printbibliography twocolumn item".split()}
LAYOUT |= {
    name: (1, True)
    for name in (
        "vspace hspace vskip hskip phantom hphantom vphantom pagenumbering thispagestyle pagestyle linespread nocite "
        "hyphenation markright enlargethispage setstretch index glossary hypersetup geometry usetikzlibrary color "
        "pagecolor institute titlerunning authorrunning acmConference subjclass keywords PARstart captionsetup "
        "floatplacement fancyhead fancyfoot setmainfont setmonofont"
    ).split()
}
LAYOUT |= {
    name: (2, False)
    for name in (
        "setlength addtolength setcounter addtocounter numberwithin markboth fontsize DeclareMathOperator settowidth "
        "addcontentsline PassOptionsToPackage AtBeginDocument RequirePackage"
    ).split()
}
LAYOUT |= {"definecolor": (3, False), "addtocontents": (3, False), "rule": (2, True)}

# Font declarations and the style they give a group.
DECLARATIONS = {name: "strong" for name in ("bf", "bfseries")}
DECLARATIONS |= {name: "emph" for name in ("it", "itshape", "em", "sl", "slshape")}
DECLARATIONS |= {name: "smallcaps" for name in ("sc", "scshape")}
DECLARATIONS |= {
    name: ""
    for name in (
        "rm sf tt rmfamily sffamily ttfamily normalfont mdseries upshape normalsize small footnotesize scriptsize "
        "tiny large Large LARGE huge Huge"
    ).split()
}

# Characters by command.
SYMBOLS = {
    "copyright": "©",
    "textregistered": "®",
    "texttrademark": "™",
    "P": "¶",
    "S": "§",
    "dag": "†",
    "ddag": "‡",
    "textbullet": "•",
    "ldots": "…",
    "dots": "…",
    "pounds": "£",
    "euro": "€",
    "degree": "°",
    "AE": "Æ",
    "ae": "æ",
    "OE": "Œ",
    "oe": "œ",
    "AA": "Å",
    "aa": "å",
    "O": "Ø",
    "o": "ø",
    "L": "Ł",
    "l": "ł",
    "ss": "ß",
    "guillemotleft": "«",
    "guillemotright": "»",
    ",": " ",
    "!": "",
    ":": " ",
    ";": " ",
    "quad": " " * 4,
    "qquad": " " * 8,
}
# Text symbols by command.
TEXT_SYMBOLS = {
    "textbackslash": "\\",
    "textasciitilde": "~",
    "textasciicircum": "^",
    "textbar": "|",
    "textless": "<",
    "textgreater": ">",
    "textunderscore": "_",
    "textemdash": "—",
    "textendash": "–",
    "textellipsis": "…",
    "textquotedblleft": "“",
    "textquotedblright": "”",
    "textquoteleft": "‘",
    "textquoteright": "’",
    "textdegree": "°",
    "texttimes": "×",
    "textpm": "±",
    "textminus": "\u2212",
    "textcent": "¢",
    "textyen": "¥",
    "textsterling": "£",
    "texteuro": "€",
    "textcopyright": "©",
    "textregistered": "®",
    "texttrademark": "™",
    "textsection": "§",
    "textparagraph": "¶",
    "textdagger": "†",
    "textdaggerdbl": "‡",
    "textperiodcentered": "·",
    "textvisiblespace": "␣",
    "textexclamdown": "¡",
    "textquestiondown": "¿",
    "textmu": "\u00b5",
    "textohm": "\u2126",
    "textnumero": "№",
    "slash": "/",
    "lbrack": "[",
    "rbrack": "]",
    "lq": "‘",
    "rq": "’",
    "dh": "ð",
    "DH": "Ð",
    "th": "þ",
    "TH": "Þ",
    "ng": "ŋ",
    "NG": "Ŋ",
    "i": "ı",
    "j": "ȷ",
}

# Accents by command (combining mark, what stands for it without a letter, letters that compose).
ACCENTS = {
    "'": ("\u0301", "´", "aeiouyAEIOUYcCnNsSzZlr"),
    "`": ("\u0300", "`", "aeiouAEIOU"),
    "^": ("\u0302", "^", "aeiouAEIOU"),
    "~": ("\u0303", "~", "anoANOuUiI"),
    '"': ("\u0308", "¨", "aeiouyAEIOU"),
    "=": ("\u0304", "¯", "aAeEiIoOuU"),
    ".": ("\u0307", "", "zZeEcCgGI"),
    "u": ("\u0306", "", "gGaAuU"),
    "v": ("\u030c", "", "cCsSzZrReEdDtTnN"),
    "H": ("\u030b", "", "oOuU"),
    "c": ("\u0327", "", "cCsStT"),
    "k": ("\u0328", "", "aAeE"),
    "r": ("\u030a", "", "aAuU"),
    "t": ("\u0361", "", ""),
}
