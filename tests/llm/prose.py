"""Made-up prose for tests."""

import random

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education".split()


def prose(seed: int, n: int = 80) -> str:
    """Sentences of n words that no other seed gives."""
    draw = random.Random(seed)
    words = [draw.choice(WORDS) + (str(seed) if draw.random() < 0.2 else "") for _ in range(n)]
    return "\n".join(" ".join(words[i:i + 12]).capitalize() + "." for i in range(0, n, 12))
