"""Tables for comparing scanned text: accents and what they stand on."""

#: Accented letters and the plain ones.
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőŕřśšşťţùúûüūůűųýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorrsssttuuuuuuuuyyzzz"
assert len(ACCENTED) == len(PLAIN)
