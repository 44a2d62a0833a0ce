"""Common words per language. Fixed values."""

COMMON = {
    "en": (
        "the of and to in is that it for was on are be with as have not this by at or we will has they would from which an been their can but one there "
        "what all if its had who no more when so said our my his were i you do should than any may other into only also up out those them very such "
        "must time he she her these now has about after again before because between could each every find first give how like let long many much "
        "never nor nothing off once over own per put right same shall since some still then through until upon us want way well where while why "
        "without yet am being does done go got make might say says see simply take tell under your me him"
    ).split(),
    "de": (
        "der die das und in den von zu ist mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind "
        "noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wir ich ihr ihnen uns dem im hier wer was "
        "kein keine nun dann wenn da unser damit dieses diese dieser diesem bitte danke davon hören hatte ihm ihn jeder jetzt können lange müssen "
        "niemand ohne schon sehr sollte tun viele weiß während weil wo wollen zuerst gegen ihre ihren seit nichts zwischen ans ins beim vom"
    ).split(),
    "fr": (
        "le la les de des du un une et à en est que qui dans pour sur pas il elle ne se ce au aux par plus ou avec son sa ses nous vous ils mais on été "
        "sont cette leur y a fait tout si je dont quand sera notre votre me te lui où donc car sans sous même très bien aussi ainsi encore jamais rien "
        "tous toute toutes ces cet quel quelle doit faut peut puisse soit serait était afin depuis lorsque puis chez dit"
    ).split(),
}
LANGUAGES = ("en", "de", "fr")
ALL = frozenset(w for v in COMMON.values() for w in v)
