"""Where rows come from: catalogues, files, vectors, chats."""
