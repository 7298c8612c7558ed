"""Personal data in formats that the templates of operator 4 lack, and look-alikes."""

import random

from siftwood.llm import op4_pii

#: Kind, text before, span, text after; # is a digit, ~ a lower-case letter, ^ a capital or a digit; an = in front asks for a right check digit.
REAL = [
    ("phone", "my new number is ", "(0###) ### ###", " since May"), ("phone", "ring ", "###/###-####", " after six"), ("phone", "telephone: ", "0### #######", "\n"),
    ("phone", "whatsapp ", "### ### ## ##", ", evenings"), ("phone", "cell: ", "###-###.####", " or mail"), ("phone", "fax ", "####-###-###", "."),
    ("card", "charged to my mastercard ", "=5### ######## ####", " yesterday"), ("card", "amex ", "=37##.######.#####", " exp 09/27"), ("card", "debit card no. ", "=4###.####.####.####", ", thanks"),
    ("national_id", "her social security number, ", "###-##-####", ", was on it"), ("national_id", "SSN# ", "### ## ####", " (copy)"),
    ("account", "send it to IBAN ", "FR## #### #### #### #### #### ###", " by Friday"), ("account", "konto ", "ES## #### #### #### #### ####", "\n"), ("account", "bank account ", "NL##ABNA##########", " please"),
    ("secret", "config: ", "passwd: ~~~~~~#~~#", "\nhost: a"), ("secret", "use ", "sk_live_^^^^^^^^^^^^^^^^^^^^^^^^", " in tests"), ("secret", "export ", "AIza^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^", " now"),
    ("secret", "the bot has ", "xoxb-############-~~~~~~~~~~~~", ""), ("secret", "my ", "api_key: '~~#~~#~~#~~#~~#~'", ""),
    ("email", "ask ", "~~~~~.~~~~~ {at} ~~~~ (dot) org", " about it"), ("email", "or ", "~~~~~_##[at]~~~~~~[dot]co[dot]uk", "!"), ("email", "write me: ", "~~~~~ AT ~~~~~ DOT net", " "), ("email", "to ", "~~~~~ (at) ~~~~.~~~~~.edu", ", or call"),
]
LIKE = [
    (None, "isbn ", "978-#-##-######-#", " in print"), (None, "it ran from ", "20##-0#-1#", " on"), (None, "at ", "1#:##:##", " sharp"), (None, "about ", "#,###,###", " people"), (None, "order no. ", "####-####-##", " shipped"),
    (None, "version ", "1#.#.####", " fixes it"), (None, "pages ", "1##-1##", " and after"), (None, "invoice ", "20##-####-###", " is due"), (None, "ticket ", "### ### ###", " was closed"), (None, "part ", "AB## ####", " is out"),
    (None, "commit ", "#~#~###~#~~##~#~###~#~#~#~#~#~#~#~#~#~#~", " broke it"), (None, "meet at noon at ", "~~~~~. ~~~~", " is closed"), (None, "lat ", "##.######, -##.######", " on the map"), (None, "won ", "##-## ##-## ##-##", " in three sets"),
    (None, "the secret", " of ~~~~~~", " is out"), (None, "serial ", "#### #### #### ####", " on the back"), (None, "a token ", "of ~~~~~~~~", " and more"), (None, "from ", "19## to 20##", " or so"), (None, "total ", "1#.###.###", " euro"),
]
_FROM = {"#": "0123456789", "~": "abcdefghiklmnoprstuw", "^": "ABCDEFGHJKLMNPQRSTUVWXYZ0123456789"}


def filled(shape: str, rng: random.Random) -> str:
    while True:
        made = "".join(rng.choice(_FROM.get(c, c)) for c in shape.lstrip("="))
        if shape[0] != "=" or op4_pii._py_luhn("".join(c for c in made if c.isdigit())):
            return made


def cases(times: int = 20, seed: int = 17) -> list[tuple[str | None, str, int, int]]:
    """(kind or None, text, start, end)."""
    rng, out = random.Random(seed), []
    for kind, before, shape, after in REAL + LIKE:
        for _ in range(times):
            span, said = filled(shape, rng), f"It was said that {before}"
            out.append((kind, said + span + after, len(said), len(said) + len(span)))
    return out
