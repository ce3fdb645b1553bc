"""Operations on text corpora; nothing outside this folder imports it."""
