"""Problem 4: personal information in free text, by a skip-chain conditional random field."""
