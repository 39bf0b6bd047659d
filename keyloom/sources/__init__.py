"""Readers: text tables with searched headers, workbooks, grouped sheets, search results, drafts."""
