"""Documents that operators must not stumble over."""

AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one two three"), (None, None), (5, "Ünïcode ſ 你好 😀 " * 3), (6, "a " * 30000), (7, "x" * 200000), (8, "\n\n\n")]
