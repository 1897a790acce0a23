import random

WORDS = "the of and to in is on that by it for with as was at from thing other water place small great still never under every white light house world again point large found study learn plant cover thought".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) + (r.choice("abcdefgh") * (i % 7 == 0))
        out.append(w + ("." if i % 11 == 10 else "") + ("\n" if i % 37 == 36 else ""))
    return " ".join(out)
