"""Lexicons used by the registered queries and the default screening run.

Fixed values: invented terms chosen to hit the driver's synthetic prose in all four languages,
plus one category that never hits (``none: alcohol``).
"""

from litsieve.functions.lexicon import Lexicon

CORE_TEXT = "alpha: the, of\nbeta: le, de\ngamma: der, das\n"
ADDITIONAL_TEXT = "delta: que, el\nnone: alcohol\nbeta: la\n"

SCORED_TEXT = "alpha: the, of, and, with\nbeta: le, de, la, des\ngamma: der, die, das, und\ndelta: que, el, los, de\n"

DIMENSIONS = {
    "Population": "children: kind, enfant\nadults: adult, ish\nelderly: eaux\n",
    "Design": "qualitative: qual\nquantitative: schaft, heit\nmixed: mixed methods\n",
}

CORE = Lexicon.from_text(CORE_TEXT)
ADDITIONAL = Lexicon.from_text(ADDITIONAL_TEXT)
SCORED = Lexicon.from_text(SCORED_TEXT)
SECONDARY = Lexicon.from_dict({"Methodology": ["tion", "ment"], "Population": ["eaux", "ung"],
                               "Setting": ["ción", "ö"], "Markup": [" | ", "(x"], "none": ["alcohol"]}, lower=True)
DIMENSION_LEXICONS = {dim: Lexicon.from_text(text, lower=True) for dim, text in DIMENSIONS.items()}
