"""Texts that several tests share."""

PASSAGE = "zwoelf boxer jagen viktor quer ueber den grossen sylter deich und zurueck nach hause heute"
BODY = " ".join(f"wort{i} the{i % 7} and{i % 5}" for i in range(60))
