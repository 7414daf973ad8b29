"""Training-data operators: language, pages, personal data, tokens, media, chats, near copies, leaks and urls."""
