"""Pure-Python cores that need a document as a whole: chunks, consolidation, HTML trees."""
