"""Operators over catalogues, files, vectors and chats: frames in, frames out."""
