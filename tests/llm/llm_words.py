"""Words as the operators take them."""

WORD = r"[^\x20\x09-\x0D]+"


def lowered(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
